"""Operator 2 end to end: every score against plain loops over the corpus, and the same scores for any number of tasks."""

import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import lm
from textloom.llm.common import words_of


def learnt(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1


@pytest.fixture(scope="module")
def some(spark, documents):
    """Whole texts, of which some occur in both folds, and odd rows."""
    rows = [(r.doc_id, r.text) for r in documents.where("doc_id < 45").collect()]
    extra = [(1000 + k, t) for k, (_, t) in enumerate(rows[:8])] + [(None, None), (7, ""), (7, "of"), (2000, "zzqx " * 40), (2001, rows[3][1] + " and more")]
    return spark.createDataFrame(rows + extra, "doc_id long, text string")


def brute_scores(df):
    rows = df.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("mark")).collect()
    sub = lm.Subwords(*lm.load_vocabulary(lm.ranks_path()))
    ids_of = lambda w: [sub.end] if w == b"" else sub.encode(" " + w.decode())
    texts = [(r.doc_id, [*words_of(r.text), b""]) for r in rows]
    train = [ws for k, ws in texts if learnt(k)]
    sample = sorted((r for r in rows if learnt(r.doc_id)), key=lambda r: r.mark)[: lm.START_DOCS]
    classes, sets, _, w = lm.start([sub.text(words_of(r.text)) for r in sample], sub.size)

    words = Counter(x for ws in train for x in ws)
    total = sum(words.values())
    ids, pairs = Counter(), Counter()
    for ws in train:
        flat = [i for x in ws for i in ids_of(x)]
        ids.update(flat)
        c = [lm.CLASSES, *(int(classes[i]) for i in flat)]
        pairs.update(zip(c[:-1], c[1:], strict=True))
    n_class = np.zeros(lm.CLASSES)
    for i in range(sub.size):
        n_class[classes[i]] += ids[i] + 0.5
    seen = Counter()
    for (_, b), n in pairs.items():
        seen[b] += n
    all_pairs = sum(pairs.values())
    prior = np.array([(seen[b] + 0.5) / (all_pairs + 0.5 * lm.CLASSES) for b in range(lm.CLASSES)])
    out_of = Counter()
    for (a, _), n in pairs.items():
        out_of[a] += n
    bigram = np.array([[math.log((pairs[a, b] + 20 * prior[b]) / (out_of[a] + 20)) for b in range(lm.CLASSES)] for a in range(lm.CLASSES + 1)])

    def attention(ws):
        """Log probability of each word by the attention model, one token at a time."""
        per_word = [ids_of(x) for x in ws]
        flat = [i for x in per_word for i in x]
        c = [int(classes[i]) for i in flat]
        before, step = np.array([lm.CLASSES] * (lm.OVERLAP + 1) + c[:-1]), lm.WINDOW - lm.OVERLAP
        logs = []
        for t, i in enumerate(flat):
            context = before[t // step * step : t + lm.OVERLAP + 1]
            s = (w["k"][context] @ w["q"][context[-1]]).astype(float) * lm.DIM**-0.5 + w["rel"][np.arange(len(context))[::-1]]
            a = np.exp(np.minimum(s, 30))
            logits = np.tanh(a / a.sum() @ w["v"][context]) @ w["u"][:, sets] + w["b"] + bigram[context[-1]]
            logs.append(logits[c[t]] - np.log(np.exp(logits).sum()) + math.log((ids[i] + 0.5) / n_class[c[t]]))
        out, at = [], 0
        for x in per_word:
            out.append(sum(logs[at : at + len(x)]))
            at += len(x)
        return out

    listed = {x: n for x, n in words.items() if n * 2**lm.SHARE_BITS >= total}
    mass = sum(listed.values()) / total

    def word_log(x, a, own, mix):
        p = (1 - mix * mass) * math.exp(a) if a > -700 else 0.0
        p += mix * max(0, listed.get(x, 0) - own) / (total - own)
        return math.log(p) if p else a + math.log(1 - mix * mass)

    def cut(ws):
        out, now = [], []
        for x in ws:
            now.append(x)
            if x and xxhash.xxh64_intdigest(x, seed=7) % lm.CHUNK_WORDS == 0:
                out.append(tuple(now))
                now = []
        return [*out, tuple(now)]

    passages, contexts = Counter(), Counter()
    for ws in train:
        parts = [None, *cut(ws)]
        passages.update(zip(parts[:-1], parts[1:], strict=True))
        contexts.update(parts[:-1])
    once, twice = (sum(n == k for n in passages.values()) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    kept = min(0.95, max(1e-6, sum(n for n in passages.values() if n > 1) / sum(passages.values())))

    found = {i: attention(ws) for i, (_, ws) in enumerate(texts)}
    begun = [attention([*words_of(r.text), b""]) for r in sample]
    sums = {m: sum(word_log(x, a, 1, m) for r, logs in zip(sample, begun, strict=True) for x, a in zip([*words_of(r.text), b""], logs, strict=True)) for m in lm.MIXES}
    mix = max(lm.MIXES, key=lambda m: sums[m])
    out = []
    for i, (k, ws) in enumerate(texts):
        own, at, score, before = int(learnt(k)), 0, 0.0, None
        for part in cut(ws):
            q = sum(word_log(x, found[i][at + n], own, mix) for n, x in enumerate(part))
            at += len(part)
            c = passages[before, part] - own
            share = (c - discount) / (contexts[before] - own) if c > 0 else 0.0
            score += np.logaddexp(math.log(kept * share), math.log(1 - kept) + q) if share else math.log(1 - kept) + q
            before = part
        out.append((k, len(ws), score / math.log(10)))
    return out


def test_scores_by_plain_loops(some):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in lm.language_model_scores(some).collect()), key=key)
    want = sorted(brute_scores(some), key=key)
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert [g[2] for g in got] == pytest.approx([x[2] for x in want], rel=1e-4)
    copied = {r[0]: r[2] / r[1] for r in got}
    assert copied[1000] > -1 > copied[2000]


def test_scores_do_not_depend_on_the_number_of_tasks(some):
    by = []
    for n in (1, 8, 51):
        rows = lm.language_model_scores(some.repartition(n)).collect()
        by.append(sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.score, r.base_score) for r in rows))
    for other in by[1:]:
        assert [r[:3] for r in other] == [r[:3] for r in by[0]]
        assert [x for r in other for x in r[3:]] == pytest.approx([x for r in by[0] for x in r[3:]], rel=1e-6)


def test_list_of_frequent_words_is_bounded_by_their_share(some, monkeypatch):
    monkeypatch.setattr(lm, "SHARE_BITS", 7)
    model, counts = lm.learn(some.where("doc_id is not null"), lm.ranks_path())
    assert 0 < len(model.top) <= 2**7 and all(c * 2**7 >= counts.total for c in model.top.values())
    brute = sorted((repr(k), n) for k, n, _ in brute_scores(some))
    rows = lm.language_model_scores(some).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in rows) == brute
    want = brute_scores(some)
    assert sorted(r.score for r in rows) == pytest.approx(sorted(x[2] for x in want), rel=1e-4)


def test_words_together_are_encoded_as_alone():
    import random

    sub, r = lm.Subwords(*lm.load_vocabulary(lm.ranks_path())), random.Random(3)
    words = ["a", "don't", "x.y", "\u00a0", "a\u2003b", "日本", "é", "…", "'s", "1234567", "_", "th\u0301e", "\ufffd", "--", "a's'b", "\x00", "\u3000"]
    for _ in range(200):
        some = ["".join(r.choice(words) for _ in range(r.randint(1, 4))).encode() for _ in range(r.randint(1, 9))]
        ids, size = sub.many(some)
        parts = np.split(ids, np.cumsum(size)[:-1])
        assert [p.tolist() for p in parts] == [sub.encode(" " + w.decode()) for w in some]


def test_all_training_texts_are_learnt_from(spark, some):
    """More texts than the 400 that the classes and weights once came from: each takes part."""
    words = [w.decode() for r in some.where("doc_id < 45").orderBy("doc_id").collect() for w in words_of(r.text)]
    texts = [" ".join(words[30 * k : 30 * k + 30]) for k in range(450)]
    model, _ = lm.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), lm.ranks_path())
    sub = lm.Subwords(*lm.load_vocabulary(lm.ranks_path()))
    classes, sets, _, w = lm.start([sub.text(words_of(t)) for t in texts], sub.size)
    assert (model.classes == classes).all() and (model.sets == sets).all()
    # What stands before a text looks back on nothing else, so its row of q has no gradient but rounding, and no effect.
    told = {name: abs(v - w[name])[: -1 if name == "q" else None].max() for name, v in model.weights.items()}
    assert max(told.values()) < 2e-4, told
    fewer = lm.start([sub.text(words_of(t)) for t in texts[:400]], sub.size)[3]
    assert max(abs(v - w[name]).max() for name, v in fewer.items()) > 1e-3


def test_each_id_is_trained_on_once_and_by_the_windows_that_score_it():
    r = np.random.default_rng(4)
    for n in (1, 17, 18, 19, 700):
        ids = r.integers(0, lm.CLASSES, n).astype(np.int32)
        laid, rounds = lm.laid_out(ids, lm.CLASSES)
        x, y = lm.windows(ids)
        on = y >= 0
        assert (np.where(laid[:, 1:] < lm.CLASSES, laid[:, 1:], -1.0) == y).all() and (laid[:, :-1][on] == x[on]).all()
        assert (laid[:, lm.OVERLAP + 1 :] < lm.CLASSES).sum() == n and set(rounds) <= set(range(lm.ROUNDS))


def test_words_that_are_not_listed_have_their_share(some):
    """A shorter list in the tasks changes no score: the other words meet their counts in the join."""
    rows = some.select("doc_id", "text", F.when(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1, 1).otherwise(0).alias("own"))
    model, counts = lm.learn(rows.where("own = 1"), lm.ranks_path())
    told = lambda m: sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.scored(rows, m, lm.ranks_path(), counts).collect())
    want = told(model)
    for least in (30, 10**9):
        got = told(replace(model, top={w: c for w, c in model.top.items() if c >= least}))
        assert [g[:3] for g in got] == [x[:3] for x in want]
        assert [x for g in got for x in g[3:]] == pytest.approx([x for r in want for x in r[3:]], rel=1e-6)
