"""All registered queries and their SQL."""

from __future__ import annotations

from textloom.plans import blocks, documents, layout, outline, reading, relational, rules, structure, writing

PLANS = (documents, relational, layout, structure, rules, blocks, writing, outline, reading)


def queries():
    return {name: f for p in PLANS for name, f in p.query.queries.items()}


def oracle_sql():
    return {name: sql for p in PLANS for name, sql in p.query.sql.items()}
