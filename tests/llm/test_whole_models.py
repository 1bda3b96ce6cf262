"""Operators 3 and 4 and the whole pipeline against plain numpy and loops: every row and score."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_fingerprints import brute_components, brute_simhash

import corpus_pipeline
from textloom.llm import langid, pieces, quality

DATA = "/root/testdata/sf0.001"


def crc(k):
    return zlib.crc32(("" if k is None else str(k)).encode())


def brute_quality(rows, labels, held=0):
    """Score of every (doc_id, text): quadratic discriminant by explicit inverses and determinants."""
    x = [quality.statistics(t) for _, t in rows]
    marks = [(k, int(y)) for k, y in labels if y in (0, 1) and k is not None]
    of = {y: np.array([v for (k, _), v in zip(rows, x, strict=True) for m, z in marks if m == k and z == y and crc(k) % 5 != held]).reshape(-1, len(quality.STATISTICS)) for y in (0, 1)}
    n = {y: len(v) for y, v in of.items()}
    prior = np.log((n[1] + 1) / (n[0] + 1))
    if min(n.values()) < 2:
        return [1 / (1 + np.exp(-prior))] * len(rows)
    cov = {y: np.cov(v.T, bias=True) for y, v in of.items()}
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / (n[0] + n[1])
    out = []
    shrunk = {}
    for y in (0, 1):
        few = len(quality.STATISTICS) / (len(quality.STATISTICS) + n[y])
        a, b = max(quality.SHRINK_DIAGONAL, few), max(quality.SHRINK_POOLED, few)
        c = (1 - b) * cov[y] + b * pooled
        shrunk[y] = (1 - a) * c + a * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
    for v in x:
        d = {}
        for y in (0, 1):
            z = v - of[y].mean(axis=0)
            d[y] = -0.5 * z @ np.linalg.inv(shrunk[y]) @ z - 0.5 * np.linalg.slogdet(shrunk[y])[1]
        out.append(1 / (1 + np.exp(-np.clip((d[1] - d[0]) / quality.TEMPERATURE + prior, -60, 60))))
    return out


def brute_profile(text, letters, cache):
    """Bundle of bound, rotated letter vectors, n-gram by n-gram."""
    s = langid.symbols(text).tolist()
    counts = Counter(tuple(s[i : i + n]) for n in langid.ORDERS for i in range(len(s) - n + 1))
    total = np.zeros(letters.placed[0].shape[1])
    for gram, n in counts.items():
        if gram not in cache:
            v = np.ones(len(total))
            for k, letter in enumerate(reversed(gram)):
                v = v * letters.placed[k][letter]
            cache[gram] = v
        total += np.sqrt(n) * cache[gram]
    size = np.linalg.norm(total)
    return total / size if size else total


def brute_languages(rows, held=1):
    """(language, score) of every (doc_id, text, lang)."""
    letters, cache = langid.Letters(langid.DIMENSIONS, langid.SEED), {}
    v = [brute_profile(t, letters, cache) for _, t, _ in rows]
    sums = {}
    for (k, _, lang), x in zip(rows, v, strict=True):
        if lang is not None and crc(k) % 3 != held and x.any():
            sums[lang] = sums.get(lang, 0) + x
    names = sorted(sums)
    if not names:
        return [("und", 0.0)] * len(rows)
    p = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    common = p.mean(axis=0) if len(p) > 1 else np.zeros(p.shape[1])
    out = []
    for x in v:
        cos = np.array([(x - common) @ (q - common) / max(1e-9, np.linalg.norm(x - common) * np.linalg.norm(q - common)) for q in p])
        e = np.exp(langid.SHARPNESS * (cos - cos.max()))
        out.append((names[cos.argmax()], e.max() / e.sum()) if x.any() else ("und", 0.0))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_quality_scores(spark, documents, odd, which):
    df = documents if which == "documents" else odd
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()] if which == "documents" else [(3, 1), (4, 0), (7, 1), (8, 0), (9, 1), (2, 0), (None, 1), (5, None)]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = quality.quality_scores(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found, want = sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((k, s) for (k, _), s in zip(rows, brute_quality(rows, labels), strict=True)), key=key)
    assert [k for k, _ in found] == [k for k, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-5, abs=1e-7)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_language_scores(documents, odd, which):
    df = documents if which == "documents" else odd
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.languages(df).collect()), key=key)
    want = sorted(((k, *x) for (k, *_), x in zip(rows, brute_languages(rows), strict=True)), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-4)


def test_whole_pipeline(spark):
    """All stages by loops: what is left, and its tokens."""
    import re

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    docs = [d for d, s in zip(docs, brute_quality([d[:2] for d in docs], labels), strict=True) if s >= quality.THRESHOLD]
    docs = [d for d, (lang, s) in zip(docs, brute_languages(docs), strict=True) if lang != "und" and s >= 0.5]
    named = {c for *_, c in brute_components([d[0] for d in docs], [brute_simhash(d[1]) for d in docs])}
    docs = [d for d in docs if d[0] in named]

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    spans = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        spans |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    kept = []
    for d in docs:
        w, hit = words(d[1]), set()
        for n in {len(s) for s in spans}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(d)
    want = sorted((k, len(library.encode(t or "", add_bos=True, add_eos=True))) for k, t, _ in kept)
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, DATA).collect()) == want
    assert 0 < len(want) < 200
