"""Document fingerprints (1) and SimHash (9) against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import simhash, weighted
from textloom.llm.common import words_of


def jaccard(a, b):
    a, b = Counter(words_of(a)), Counter(words_of(b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def brute_pairs(rows, sampler):
    def mark(text):  # Spark's xxhash64, as a signed long
        h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
        return h - 2**64 if h >= 2**63 else h

    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1])))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        new = weighted.edited(text, following)
        a, b, c = (sampler.fingerprint(t) for t in (text, new, following))
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), weighted.hex_of(a), weighted.hex_of(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=repr)


def test_every_row_and_its_next(spark, documents, odd):
    sampler = weighted.Sampler(weighted.gamma_quantiles())
    for df in (documents, odd):
        got = [tuple(r) for r in weighted.compared_with_next(df).collect()]
        assert sorted(got, key=repr) == brute_pairs([(r.doc_id, r.text) for r in df.collect()], sampler)


def test_likeness_estimates_generalised_jaccard(documents):
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    sampler = weighted.Sampler(weighted.gamma_quantiles())
    errors = []
    for a, b in zip(texts, texts[1:], strict=False):
        new = weighted.edited(a or "", b or "")
        errors.append(weighted.likeness(sampler.fingerprint(a), sampler.fingerprint(new)) - jaccard(a, new))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_weights_count():
    s = weighted.Sampler(weighted.gamma_quantiles())
    for n, m in ((1, 2), (3, 4), (1, 9)):
        a, b = " ".join(f"w{k} " * n for k in range(300)), " ".join(f"w{k} " * m for k in range(300))
        assert abs(weighted.likeness(s.fingerprint(a), s.fingerprint(b)) - n / m) < 0.15
    assert (s.fingerprint("") == s.fingerprint(None)).all() and (s.fingerprint("A b") == s.fingerprint(" a\nB ")).all()


def test_empty_tables(empty):
    assert weighted.compared_with_next(empty).count() == 0
    assert weighted.fingerprints(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_one_row_is_its_own_next(spark):
    r = weighted.compared_with_next(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert r.near_next == 1.0


def brute_simhash(text):
    w = words_of(text)
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for k in range(i):
            if (fps[i] ^ fps[k]).bit_count() <= most:
                root[find(i)] = find(k)
    out = {}
    for i in range(len(ids)):
        out.setdefault(find(i), []).append(ids[i])
    named = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return sorted(((ids[i], fps[i], named[find(i)]) for i in range(len(ids))), key=repr)


def test_components_against_all_pairs(documents, odd):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
        assert got == brute_components([r.doc_id for r in rows], [brute_simhash(r.text) for r in rows])


def test_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:  # chains of small steps, far from each other
        x = b
        for _ in range(r.randint(0, 12)):
            for bit in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    links = simhash.near_links(df)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(links).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups, brute = {}, {}
    for k, x in enumerate(fps):
        groups.setdefault(roots.get(x, x), set()).add(k)
    for k, _, c in want:
        brute.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_long_lists_are_linked_like_short_ones():
    v = np.random.default_rng(0).integers(0, 2**16, 900).astype(np.int64) << 20
    assert sorted(simhash.spanning_links(v, 2)) == sorted(simhash.spanning_links_wide(v, 2))


def test_star_rounds_close_long_paths(spark):
    n = 3000
    df = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash.components(df).select(F.min("root"), F.max("root"), F.count("*")).first() == (0, 0, n - 1)


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "date", "string"])
def test_neighbours_for_ids_of_any_type(spark, kind):
    ids = ["2024-01-01", "2024-01-02", "2024-01-03"] if kind == "date" else ["1", "2", "3"]
    docs = spark.createDataFrame([(ids[0], "a b c d"), (ids[1], "e f g h i"), (ids[2], None), (None, "z")], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = weighted.compared_with_next(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = {r.k: (r.n_chars, r.edited_sha256) for r in got.select(F.col("doc_id").cast("string").alias("k"), "*").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {ids[2]: (0, digest("")), ids[1]: (9, digest("e f g a b")), ids[0]: (7, digest("a b cz")), None: (1, digest("z"))}


def test_rows_of_one_id_spread_over_tasks(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3).cast("string")).alias("text")).repartition(4)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = weighted.compared_with_next(docs)
        assert got.count() == 400 and got.where("near_next = 1").count() >= 400 - 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_long_lists_are_split(spark):
    """More than SPLIT fingerprints that share two blocks: the same components as by all pairs."""
    r = random.Random(8)
    fps = sorted({(0x1122334400000000 | (r.getrandbits(8) << 24) | (r.getrandbits(3) << 8) | r.getrandbits(4)) for _ in range(900)})
    assert len(fps) > simhash.SPLIT
    df = spark.createDataFrame([(k,) for k in fps], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(df)).collect()}
    assert sorted((k, fp, fps.index(roots.get(fp, fp))) for k, fp in enumerate(fps)) == sorted(brute_components(list(range(len(fps))), fps))
