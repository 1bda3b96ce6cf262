"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a vector of statistics (character classes, word shapes, repetition, line shapes,
compressibility), every one transformed so that clean prose is close to Gaussian. Per class the mean and the
covariance come from moments summed over all labelled training rows, in the tasks that hold them; covariances are
shrunk towards their diagonal and towards the pooled one. A score is the logistic of the difference of
log densities (Mahalanobis distances through Cholesky factors computed once) plus the log prior ratio.

Null and empty texts have statistics of their own (no words) and are scored like any other. Labels that are
null or of ids without text row are ignored; an id labelled twice counts twice. Without labels of both classes
the prior alone decides (0.5 without any label).
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import crc_mod, prepare, stored

THRESHOLD = 0.3
TEMPERATURE = 4.0
SHRINK_DIAGONAL = 0.15
SHRINK_POOLED = 0.05

#: Classes of bytes for the character statistics.
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _BANG, _SYMBOL, _PIPE, _OTHER, _HIGH = range(11)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _HIGH
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[9, 11, 12, 13, 32]] = _SPACE
_CLASS[10] = _LINE
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = _STOP
_CLASS[[ord(c) for c in "!?"]] = _BANG
_CLASS[[ord(c) for c in "#$%&*@^~<>=+_{}[]\\/`"]] = _SYMBOL
_CLASS[ord("|")] = _PIPE

STATISTICS = [
    "words", "word_length", "upper", "digit", "stop", "bang", "symbol", "pipe", "distinct", "top_word", "adjacent",
    "odd_end", "capital_words", "line_length", "repeated_lines", "longest_word", "compressed", "no_letter_words", "sentence",
]


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) if raw else np.zeros(11)
    letters = c[_UPPER] + c[_LOWER] + c[_HIGH]
    visible = max(1, size - c[_SPACE] - c[_LINE])
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, n)
    share = lambda x, of: np.log((x + 0.02) / (max(1, of) + 4) + 0.003)
    ends = sum(v for w, v in counts.items() if _CLASS[w[-1]] in (_SYMBOL, _BANG, _PIPE))
    capital = sum(v for w, v in counts.items() if 65 <= w[0] <= 90 or w[0] == 0xC3 and b"\x80" <= w[1:2] <= b"\x9e")  # ASCII or Latin-1 capitals
    bare = sum(v for w, v in counts.items() if not w.strip(b"0123456789.,;:'\"()-!?#$%&*@^~<>=+_{}[]\\/`|"))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return np.array([
        np.log1p(n),
        np.log(visible / m + 0.1),
        share(c[_UPPER], letters),
        share(c[_DIGIT], visible),
        share(c[_STOP], visible),
        share(c[_BANG], visible),
        share(c[_SYMBOL], visible),
        share(c[_PIPE], visible),
        np.log((len(counts) + 1) / (n + 1) ** 0.85),
        share(max(counts.values(), default=0), m) if n > 20 else share(0.05, 1),
        share(same, m),
        share(ends, m),
        share(capital, m),
        np.log((n + 1) / (len(lines) + 1)),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(max(map(len, counts), default=0)),
        np.log((len(zlib.compress(raw, 1)) + 20) / (size + 60) ** 0.95),
        share(bare, m),
        np.log((raw.count(b".") + 1) / (n + 10)),
    ])


@dataclass
class Moments:
    """Count, sum and sum of outer products of the rows of one class."""

    n: float
    s: np.ndarray
    ss: np.ndarray

    @classmethod
    def none(cls) -> Moments:
        k = len(STATISTICS)
        return cls(0.0, np.zeros(k), np.zeros((k, k)))


class Discriminant:
    """Gaussian class densities with shrunk covariances; the Cholesky factors are kept."""

    def __init__(self, moments: dict[int, Moments], diagonal: float = SHRINK_DIAGONAL, pooled: float = SHRINK_POOLED, temperature: float = TEMPERATURE):
        self.temperature = temperature
        n0, n1 = moments[0].n, moments[1].n
        self.prior = float(np.log((n1 + 1) / (n0 + 1)))
        self.ready = min(n0, n1) >= 2
        if not self.ready:
            return
        cov = {k: m.ss / m.n - np.outer(m.s / m.n, m.s / m.n) for k, m in moments.items()}
        both = (cov[0] * n0 + cov[1] * n1) / (n0 + n1)
        self.mean = {k: m.s / m.n for k, m in moments.items()}
        self.inverse, self.log_det = {}, {}
        for k, m in moments.items():
            few = len(STATISTICS) / (len(STATISTICS) + m.n)
            a, b = max(diagonal, few), max(pooled, few)
            x = (1 - b) * cov[k] + b * both
            x = (1 - a) * x + a * np.diag(np.diag(x)) + 1e-4 * np.eye(len(x))
            chol = np.linalg.cholesky(x)
            self.inverse[k] = np.linalg.inv(chol)
            self.log_det[k] = 2 * float(np.log(np.diag(chol)).sum())

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.prior)
        d = {k: -0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)}
        return (d[1] - d[0]) / self.temperature + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_ratio(x), -60, 60)))


def _statistics_batches(batches):
    for b in batches:
        rows = [statistics(x.as_py()) for x in b.column(1)]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column(0), vectors], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_statistics_batches, f"doc_id {kind}, x array<double>")


def _moment_batches(batches):
    got = {0: Moments.none(), 1: Moments.none()}
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS))
        y = b.column(1).to_numpy()
        for k, m in got.items():
            z = x[y == k]
            m.n += len(z)
            m.s += z.sum(axis=0)
            m.ss += z.T @ z
    yield pa.RecordBatch.from_pydict({
        "y": pa.array([0, 1], pa.int32()),
        "m": pa.array([np.concatenate([[m.n], m.s, m.ss.ravel()]).tolist() for m in got.values()], pa.list_(pa.float64())),
    })


def fit(stats: DataFrame, labels: DataFrame, **options) -> Discriminant:
    """Sum the moments of all rows of ``stats`` that ``labels(doc_id, quality)`` marks 0 or 1."""
    marked = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = stats.join(marked, "doc_id").select("x", "y").mapInArrow(_moment_batches, "y int, m array<double>")
    sums = rows.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    k = len(STATISTICS)
    flat = {0: np.zeros(1 + k + k * k), 1: np.zeros(1 + k + k * k)}
    for r in sums:
        flat[r["y"]][r["i"]] = r["v"]
    return Discriminant({y: Moments(v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for y, v in flat.items()}, **options)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` with ``score`` in place of the vector."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of rows with crc32(doc_id) mod ``folds`` = ``held`` aren't learnt."""
    stats = stored(document_statistics(docs), "quality")
    model = fit(stats.where(crc_mod("doc_id", folds) != held), labels)
    return scored(stats, model).select(
        "doc_id",
        (crc_mod("doc_id", folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )
