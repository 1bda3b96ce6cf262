"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions. Two fingerprints that differ in at most two bits differ in
at most two bytes, so they share at least six positional bytes: six is the guaranteed minimum of the tally, and their differing
bytes leave at least two of the four two-byte blocks whole.

The index posts each fingerprint under its six pairs of blocks (four positional bytes each), so every wanted pair meets in a
posting list. In a list the shared positional bytes of each pair are tallied, pairs that reach the minimum are retained, and
those are verified bit by bit. A list of more than SPLIT fingerprints is posted again under each choice of six positions that
holds its four: there a pair meets exactly if its tally reaches six, and only 16 bits are free, so that a list
has at most 65,536 different entries, however large the corpus is, and neighbours are looked up by flipping bits. Lists give
spanning links, never all pairs.

Exact copies collapse to one fingerprint before indexing, links are closed to components by alternating
large-star and small-star rounds on tables in the shared folder, and membership is joined back.

Nulls and texts without words get fingerprint zero and are linked like any other; repeated rows stay
repeated rows in the same component; a null doc_id takes part but never names a component unless alone. Only doc_id and text are
read: other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import prepare, stored, words_of
from textloom.operators.graph import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
POSITIONS = 8
#: Fingerprints of more than one in HOT rows are joined by a broadcast.
HOT = 10_000
#: Lists of more fingerprints are split by two more positions.
SPLIT = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; shingles count as often as they occur."""
    w = words_of(text)
    if not w:
        return 0
    if len(w) < shingle:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    ones = np.zeros(64, np.int64)
    n = 0
    digests = map(xxhash.xxh64_digest, parts, repeat(SEED))
    while True:
        block = b"".join(x for x, _ in zip(digests, range(65536), strict=False))
        if not block:
            break
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(bits)
        if len(bits) < 65536:
            break
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per document row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), f"doc_id {kind}, fp long")


def _mask(positions: tuple[int, ...]) -> int:
    """Mask of byte positions, as a signed long."""
    m = sum(0xFF << (8 * k) for k in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def least_shared(max_bits: int) -> int:
    """Positional bytes that any two fingerprints within ``max_bits`` share."""
    return POSITIONS - max_bits


def block_pairs(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of every choice of whole blocks: POSITIONS / 2 blocks of two bytes, of which ``max_bits`` may differ."""
    blocks = [(k, k + 1) for k in range(0, POSITIONS, 2)]
    return [tuple(k for b in some for k in b) for some in combinations(blocks, len(blocks) - max_bits)]


def tallied(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of ``values``) that share the guaranteed number of positional bytes and are within ``max_bits``."""
    u = values.view(np.uint64)
    shared = ((u[:, None] ^ u[None, :]).view(np.uint8).reshape(len(u), len(u), POSITIONS) == 0).sum(axis=2, dtype=np.uint8)
    a, b = np.nonzero(np.triu(shared >= least_shared(max_bits), 1))
    near = np.bitwise_count(u[a] ^ u[b]) <= max_bits
    return a[near], b[near]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component under links a-b of 0 .. n-1."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) of the components of one posting list, through the tally of its pairs."""
    v = np.unique(values)
    if len(v) < 2:
        return []
    a, b = tallied(v, max_bits)
    return [(int(v[i]), int(v[k])) for i, k in enumerate(labels(len(v), a, b)) if i != k]


def spanning_links_wide(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The same for a list of entries that share the guaranteed bytes: neighbours are looked up by flipping the free bits, linear in the list."""
    v = np.unique(values)
    u = v.view(np.uint64)
    free = [int(b) for b in range(64) if (np.bitwise_or.reduce(u ^ u[0]) >> np.uint64(b)) & np.uint64(1)]
    flips = [np.uint64(sum(1 << b for b in c)) for k in range(1, max_bits + 1) for c in combinations(free, k)]
    order = np.argsort(u, kind="stable")
    su = u[order]
    hops = []
    for f in flips:
        want = su ^ f
        at = np.minimum(np.searchsorted(su, want), len(su) - 1)
        hit = su[at] == want
        hops.append((order[np.nonzero(hit)[0]], order[at[hit]]))
    a, b = (np.concatenate(x) for x in zip(*hops, strict=True))
    return [(int(v[i]), int(v[k])) for i, k in enumerate(labels(len(v), a, b)) if i != k]


def _links(max_bits: int):
    def run(batches):
        for b in batches:
            out: list[tuple[int, int]] = []
            for x in b.column(0):
                values = x.values.to_numpy()
                out += (spanning_links if len(values) <= SPLIT else spanning_links_wide)(values, max_bits)
            a, c = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links (a > b) between the different fingerprints of ``fps(fp)`` at <= max_bits differing bits.

    ``max_bits`` is 1, 2 or 3: at least one of the four blocks has to stay whole.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    choices = block_pairs(max_bits)
    posted = F.array(*[F.struct(F.lit(k).cast("byte").alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("k")) for k, c in enumerate(choices)])
    postings = fps.select("fp", F.explode(posted).alias("x")).select("fp", "x.p", "x.k")
    sizes = stored(postings.groupBy("p", "k").agg(F.count("*").alias("n")).where("n > 1"), "posting-sizes")
    met = postings.join(sizes, ["p", "k"])
    short = met.where(F.col("n") <= SPLIT).groupBy("p", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    # Long lists: every choice of the guaranteed number of positions that holds the list's own.
    finer = [[_mask(tuple(sorted((*c, *more)))) for more in combinations([k for k in range(POSITIONS) if k not in c], least_shared(max_bits) - len(c))] for c in choices]
    masks = F.element_at(F.array(*[F.array(*[F.lit(m) for m in some]) for some in finer]), F.col("p").cast("int") + 1)
    wide = met.where(F.col("n") > SPLIT).select("fp", F.explode(masks).alias("m")).select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
    wide = wide.groupBy("m", "k").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return short.unionByName(wide).mapInArrow(_links(max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per document row; component_id is the smallest doc_id reachable by links."""
    found = stored(fingerprints(docs, shingle), "simhash")
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    roots = components(near_links(fps.select("fp"), max_bits))
    # Only classes with a link get their name from the component; the others name themselves.
    members = roots.join(fps, roots.node == fps.fp).groupBy("root").agg(F.min("rep").alias("least"))
    named = members.join(fps, members.root == fps.fp).select("root", F.least("least", "rep").alias("component_id"))
    moved = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id").unionByName(named.select(F.col("root").alias("fp"), "component_id"))
    ids = stored(fps.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id")), "named")
    # A fingerprint of over 1 / HOT of all rows would be one task of the join: there are fewer than HOT of them, and they are broadcast.
    often = F.col("n") * HOT > F.lit(found.count())
    hot = F.broadcast(ids.where(often).drop("n"))
    rest = found.join(hot, "fp", "left_anti").join(ids.where(~often), "fp")
    return found.join(hot, "fp").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))


def hex_fp(col: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")
