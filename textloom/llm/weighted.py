"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (how often each occurs). For every sample and word, hashing gives a rate r and a
level c with gamma(2, 1) distribution and an offset b, uniform; with t = floor(ln(weight) / r + b) the word's value is
ln c - r * (t - b + 1), and the sample is the least value. Two texts agree in a sample with the probability that is the
generalised Jaccard similarity of their weights: sum of minima over sum of maxima. A fingerprint keeps 16 bits of
each of SAMPLES samples; ``likeness`` is the share of equal ones (standard error at most 0.045).

The gamma quantiles come from one table that the driver makes and ships, so all machines compute the same bits. Rows of values
are remembered by (word, weight) in a table of bounded size. That changes no result.

Null is the empty text. A text without words has the fingerprint of all ones. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import n_partitions, prepare, stored, words_of

SAMPLES = 128
SEED = 7
REMEMBERED = 120_000
#: Rows of values gathered at once for one text.
BLOCK = 512


def gamma_quantiles() -> np.ndarray:
    """Quantiles of gamma(2, 1) at the middles of 2^16 equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    u = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = -np.expm1(-mid) - mid * np.exp(-mid) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return ((low + high) / 2).astype(np.float32)


class Sampler:
    def __init__(self, quantiles: np.ndarray, samples: int = SAMPLES, seed: int = SEED):
        self.quantile, self.log_quantile = quantiles, np.log(quantiles.astype(np.float64)).astype(np.float32)
        self.seed, self.samples = seed, samples
        self.streams = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.rows: dict = {}
        self.values = np.empty((REMEMBERED, samples), np.float32)

    @classmethod
    def shared(cls, tables: tuple[np.ndarray, np.ndarray], samples: int, seed: int) -> Sampler:
        out = cls(tables[0], samples, seed)
        out.log_quantile = tables[1]
        return out

    def make(self, keys: list, out: np.ndarray) -> None:
        """Values of the keys, words (weight 1) or (word, weight)."""
        for lo in range(0, len(keys), 64):
            part = keys[lo : lo + 64]
            words = [k if type(k) is bytes else k[0] for k in part]
            weight = np.log(np.array([1 if type(k) is bytes else k[1] for k in part], np.float64)).astype(np.float32)[:, None]
            h = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in words), np.uint64, len(part))
            z = h[:, None] + self.streams
            z ^= z >> np.uint64(30)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(27)
            z *= np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            bits = z.view(np.uint16).reshape(len(part), self.samples, 4)
            r = self.quantile[bits[:, :, 0]]
            b = (bits[:, :, 2].astype(np.float32) + np.float32(0.5)) * np.float32(1 / 65536)
            t = np.floor(weight / r + b)
            out[lo : lo + len(part)] = self.log_quantile[bits[:, :, 1]] - r * (t - b + np.float32(1))

    def places(self, keys: list) -> np.ndarray:
        """Rows of ``values`` that hold the keys; at most REMEMBERED keys."""
        got = [self.rows.get(k, -1) for k in keys]
        at = np.array(got, np.int64)
        missing = np.nonzero(at < 0)[0]
        if len(missing):
            if len(self.rows) + len(missing) > REMEMBERED:
                self.rows.clear()
                missing = np.arange(len(keys))
            first = len(self.rows)
            new = [keys[i] for i in missing.tolist()]
            self.make(new, self.values[first : first + len(new)])
            at[missing] = np.arange(first, first + len(new))
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
        return at

    def fingerprint(self, text: str | None) -> np.ndarray:
        """SAMPLES unsigned 16-bit integers."""
        keys = [w if n == 1 else (w, n) for w, n in Counter(words_of(text)).items()]
        if not keys:
            return np.full(self.samples, 0xFFFF, np.uint16)
        least = None
        for lo in range(0, len(keys), BLOCK):
            part = self.values[self.places(keys[lo : lo + BLOCK])].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        mixed = (least + np.float32(0)).view(np.uint32) * np.uint32(0x9E3779B1)
        return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hex_of(fp: np.ndarray) -> str:
    return fp.astype("<u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    q = gamma_quantiles()
    return q, np.log(q.astype(np.float64)).astype(np.float32)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint as hex digits) for every row."""
    prepare(docs.sparkSession)
    tables = _tables()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = Sampler.shared(tables, samples, seed)
        for b in batches:
            fps = [hex_of(s.fingerprint(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _row(s: Sampler, text: str, own: np.ndarray, next_text: str, next_fp: np.ndarray) -> tuple:
    new = edited(text, next_text)
    fp = s.fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own.tobytes(), fp.tobytes(), likeness(own, fp), likeness(own, next_fp)


def compared_with_next(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Every row compared with its edited text and with the next row by descending doc_id; the last one's next is the first.

    Rows of one doc_id (of any type with an order) follow each other by a hash of their text; rows of a null doc_id come last.
    Texts are shuffled once, by ranges of doc_id, hash and place in the input, so rows of one id, even equal ones, spread over
    tasks; each task compares neighbours as they stream by. The first and last row of each partition are
    finished afterwards: two rows for each partition, whatever the input's size. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    tables = _tables()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").asc(), F.col("place").asc()]
    ranged = rows.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        s, part = Sampler.shared(tables, samples, seed), TaskContext.get().partitionId()
        names = ["doc_id", *[x.split()[0] for x in _FIELDS.split(", ")], "edge", "part", "text"]

        def batch(out, id_kind):
            cols = list(zip(*out, strict=True))
            kinds = [id_kind, *_KINDS, pa.string(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        last = None  # (doc_id, text, fingerprint) that waits for the next row
        for b in batches:
            out, id_kind = [], b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fp = s.fingerprint(text)
                if last is None:
                    out.append((doc_id, None, None, fp.tobytes(), None, None, None, "first", part, text))
                else:
                    out.append((last[0], *_row(s, last[1], last[2], text, fp), None, part, None))
                last = (doc_id, text, fp)
            if out:
                yield batch(out, id_kind)
        if last is not None:
            yield batch([(last[0], None, None, last[2].tobytes(), None, None, None, "last", part, last[1])], id_kind)

    found = stored(ranged.mapInArrow(run, f"doc_id {kind}, {_FIELDS}, edge string, part int, text string"), "weighted")
    edges = found.where("edge is not null")
    firsts = edges.where("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    # One row for each partition, in one task: its number does not grow with the rows.
    wrap = Window.orderBy("part")
    head = firsts.orderBy("part").limit(1).select(F.struct("next_text", "next_fp").alias("head"))
    nexts = firsts.select(F.lead("part").over(wrap).alias("to"), "part").select("part", "to")
    after = nexts.join(firsts.withColumnRenamed("part", "to"), "to", "left").select("part", "next_text", "next_fp")
    open_ = edges.where("edge = 'last'").select("doc_id", "part", "text", "fingerprint").join(after, "part").join(F.broadcast(head), F.lit(True))
    open_ = open_.select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "head.next_text").alias("next_text"), F.coalesce("next_fp", "head.next_fp").alias("next_fp")
    )

    def finish(batches):
        s = Sampler.shared(tables, samples, seed)
        for b in batches:
            _, text, own, next_text, next_fp = (b.column(k).to_pylist() for k in range(5))
            fp = lambda x: np.frombuffer(x, np.uint16)
            out = [_row(s, t, fp(o), n, fp(m)) for t, o, n, m in zip(text, own, next_text, next_fp, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)]], ["doc_id", *[x.split()[0] for x in _FIELDS.split(", ")]])

    closed = open_.mapInArrow(finish, f"doc_id {kind}, {_FIELDS}")
    inner = found.where("edge is null").select(closed.columns)
    return inner.unionByName(closed).withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
