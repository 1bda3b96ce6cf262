"""Training-data operators: fingerprints, scoring, filtering, formatting, extraction and archives.

Nothing outside this subpackage imports it.
"""
