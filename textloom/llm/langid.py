"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point and a seed. An n-gram vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its place; word edges count as one letter of their own. A
document's vector bundles (adds) the vectors of all n-grams of its whole text, a language's prototype bundles the
unit vectors of all its training documents. What is common to all prototypes is taken off, and a document gets the
language whose prototype has the greatest cosine with it. The score is that of a softmax over the cosines.

Letters are lower-cased; digits, marks and symbols separate words. A null text or one without any letter is ``und``
with score 0. Training rows need a non-null language and a letter. Ties go to the first language by name; without
training rows everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import crc_mod, prepare

DIMENSIONS = 512
SEED = 11
ORDERS = (2, 3)
SHARPNESS = 12.0
UNKNOWN = "und"
#: Documents of a batch whose n-grams are bundled by one matrix product.
BLOCK = 64
#: Symbols: 0 is the edge, 1 to 26 the ASCII letters, code points above share the rest by remainder.
SYMBOLS = 512

_ASCII = np.zeros(128, np.int64)
_ASCII[97:123] = np.arange(1, 27)


class Letters:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        signs = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
        #: By place from the last letter: rotated that many steps.
        self.placed = [np.roll(signs, k, axis=1).astype(np.float32) for k in range(max(ORDERS))]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams coded in base SYMBOLS with a leading count of letters."""
        order, rest = grams // SYMBOLS ** max(ORDERS), grams % SYMBOLS ** max(ORDERS)
        out = np.ones((len(grams), self.placed[0].shape[1]), np.float32)
        for k, placed in enumerate(self.placed):
            on = order > k
            out[on] *= placed[(rest[on] // SYMBOLS**k) % SYMBOLS]
        return out


def symbols(text: str | None) -> np.ndarray:
    """The text as symbols, with one edge between words and at both ends; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.where(cp < 128, _ASCII[np.minimum(cp, 127)], 0)
    high = np.nonzero(cp >= 128)[0]
    if len(high):
        seen, back = np.unique(cp[high], return_inverse=True)
        as_symbol = np.array([27 + int(c) % (SYMBOLS - 27) if chr(c).isalpha() else 0 for c in seen])
        s[high] = as_symbol[back]
    if not s.any():
        return np.zeros(0, np.int64)
    keep = np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])
    s = s[keep]
    return np.concatenate([[0] if s[0] else [], s, [0] if s[-1] else []]).astype(np.int64)


def gram_codes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of one document and how often each occurs."""
    codes = []
    for n in ORDERS:
        if len(s) >= n:
            c = sum(s[k : len(s) - n + 1 + k] * SYMBOLS ** (n - 1 - k) for k in range(n))
            codes.append(c + n * SYMBOLS ** max(ORDERS))
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def profiles(texts: list[str | None], letters: Letters) -> np.ndarray:
    """Unit document vectors, zero for texts without letter."""
    out = np.zeros((len(texts), letters.placed[0].shape[1]), np.float32)
    for lo in range(0, len(texts), BLOCK):
        got = [gram_codes(symbols(t)) for t in texts[lo : lo + BLOCK]]
        codes = np.concatenate([c for c, _ in got])
        if not len(codes):
            continue
        distinct, back = np.unique(codes, return_inverse=True)
        rows = np.repeat(np.arange(len(got)), [len(c) for c, _ in got])
        counts = np.sqrt(np.concatenate([n for _, n in got])).astype(np.float32)
        for start in range(0, len(distinct), 8192):  # bounds the vectors held at once
            part = (back >= start) & (back < start + 8192)
            weights = np.zeros((len(got), min(8192, len(distinct) - start)), np.float32)
            weights[rows[part], back[part] - start] = counts[part]
            out[lo : lo + BLOCK] += weights @ letters.vectors(distinct[start : start + 8192])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Prototypes:
    def __init__(self, sums: dict[str, np.ndarray]):
        self.names = sorted(sums)
        if self.names:
            p = np.array([sums[k] / max(1e-9, np.linalg.norm(sums[k])) for k in self.names], np.float32)
            self.common = p.mean(axis=0) if len(p) > 1 else np.zeros(p.shape[1], np.float32)
            p = p - self.common
            self.unit = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    def predict(self, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
        some = vectors.any(axis=1)
        if not self.names:
            return [UNKNOWN] * len(vectors), np.zeros(len(vectors))
        x = vectors - self.common
        cosine = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)) @ self.unit.T
        e = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
        best = cosine.argmax(axis=1)
        score = e[np.arange(len(e)), best] / e.sum(axis=1)
        return [self.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def _bundles(dimensions: int, seed: int):
    def run(batches):
        letters, sums = Letters(dimensions, seed), {}
        for b in batches:
            v = profiles(b.column(0).to_pylist(), letters)
            langs = np.array(b.column(1).to_pylist(), object)
            for k in set(langs.tolist()):
                sums[k] = sums.get(k, 0) + v[langs == k].sum(axis=0, dtype=np.float64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k]), "v": pa.array([np.asarray(v).tolist()], pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> Prototypes:
    """Bundle each language of ``docs(text, lang)`` over all rows; what comes back is one vector per language."""
    prepare(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_bundles(dimensions, seed), "lang string, v array<double>")
    sums: dict[str, np.ndarray] = {}
    for r in rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        sums.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return Prototypes({k: v for k, v in sums.items() if v.any()})


def predicted(docs: DataFrame, model: Prototypes, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        letters = Letters(dimensions, seed)
        for b in batches:
            names, score = model.predict(profiles(b.column(1).to_pylist(), letters))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows with crc32(doc_id) mod ``folds`` = ``held`` aren't learnt."""
    model = fit(docs.where(crc_mod("doc_id", folds) != held))
    return predicted(docs, model).select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
