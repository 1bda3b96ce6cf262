"""Alignment of two tokenizers over the same texts, and corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE and B a merge-type model with byte fallback; both cut the bytes of a space and the text. A token of A and
a token of B are linked if their byte ranges overlap. Over the bipartite graph of tokens and overlaps, union-find gives connected components:
they are exactly the minimal groups between byte offsets where tokens of both end. Members of a component, in order, are its expanded links.

Texts are cut into chunks before a single space that follows another character than a space and is followed by none of white space: there A's
pre-tokenizer always starts a new word, and B has no piece with a space behind another character (checked when the model is loaded;
else texts stay whole). So tokens and components never cross a cut: new chunks of many texts are encoded as one string and aligned at once, and
each worker process remembers them (REMEMBERED; the table starts anew between groups of texts). A text's values are
sums over its chunks, in parts of at most GROUP characters, whatever its length. That changes no result.

The texts are read and encoded once. Their sums and their distinct pairs of linked ids, with how often each occurs, are stored; an id pair's
count, the number of documents that hold it linked, is a count over the stored pairs. The BROADCAST_PAIRS pairs with the
highest counts are broadcast, and so is the highest count of each id of A (as many as the vocabulary has); a document sends all its other
pairs, which are rare by this order, to a join with their counts and gets the sums back by its stored row number.

Defined results: null and empty texts, and texts whose joined tokens differ from space and text (those with U+2581), have no tokens: zeros and an
empty string. Repeated rows are documents of their own. doc_id is only carried. Columns other than doc_id and text are not read and may
have any name. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import prepare, stored

REMEMBERED, GROUP = 400_000, 1 << 20
BROADCAST_PAIRS = 1_000_000
#: Characters of new chunks that are encoded as one string; a longer chunk is not remembered.
JOINED, LONG_CHUNK = 1 << 16, 256
SPACE = "▁"
#: A space where a text is not cut: beside white space of any kind or an end.
_ODD = re.compile(r"^\s| (?=\s)|\s$")
_SUMS = "doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256"


def byte_alphabet() -> dict[str, int]:
    """The characters of byte-level vocabularies: visible bytes stand for themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: the larger root of every edge is hung under the smaller one, paths are halved to their roots."""
    parent = np.arange(n)
    while True:
        x, y = parent[u], parent[v]
        if (x == y).all():
            return parent
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not ((up := parent[parent]) == parent).all():
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens with common bytes, in order: places in A and in B, and where the common bytes end."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each token of A and of B, numbered in order."""
    i, j, _ = overlaps(ends_a, ends_b)
    root = union_find(len(ends_a) + len(ends_b), i, len(ends_a) + j)
    number = np.searchsorted(np.unique(root), root)
    return number[: len(ends_a)], number[len(ends_a) :]


class Aligner:
    """Encodes chunks with both tokenizers and remembers what a document needs of them."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        alphabet = byte_alphabet()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [special.get(i) or bytes(alphabet[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        n_b, piece = self.b.get_piece_size(), self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(n_b)]
        self.cuts = not any(SPACE in piece(i).lstrip(SPACE) for i in range(n_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.length_a, self.length_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        # ids as text with what may follow them: of A a comma or bar; of B a comma, semicolon or the chunk's end
        self.written = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in (",", ";", "\n")]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        #: Of each chunk: tokens of A (-1 if the bytes differ) and of B, groups, links, and where its links start.
        self.sizes = np.zeros((1024, 5), np.int64)
        self.links = np.zeros(4096, np.int64)  # a << 32 | b of each link
        self.n_links = 0

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text without the space before each."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        if _ODD.search(text) is None:
            return parts
        out = [[parts[0]]]
        before = parts[0]
        for part in parts[1:]:
            if before and part and not part[0].isspace():
                out.append([part])
            else:
                out[-1].append(part)
            before = part
        return [" ".join(x) for x in out]

    def learn(self, found: list[str]) -> None:
        """Encodes and aligns new chunks, as many as JOINED characters at once."""
        together, size = [], 0
        for chunk in found:
            if not chunk or chunk[0].isspace() or chunk[-1] == " " or len(chunk) > JOINED:
                self._align([chunk])
                continue
            together.append(chunk)
            size += len(chunk) + 1
            if size > JOINED:
                self._align(together)
                together, size = [], 0
        if together:
            self._align(together)

    def _align(self, chunks: list[str]) -> None:
        text = " ".join(chunks)
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        fine = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        if not fine and len(chunks) > 1:
            for chunk in chunks:
                self._align([chunk])
            return
        first = len(self.groups)
        self.number.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        while first + len(chunks) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        if not fine:
            self.groups.append("")
            self.sizes[first] = -1, 0, 0, 0, self.n_links
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        i, j, link_ends = overlaps(ends_a, ends_b)
        root = union_find(len(a) + len(b), i, len(a) + j)
        roots = np.unique(root)
        group = np.searchsorted(roots, root)
        group_a, group_b = group[: len(a)], group[len(a) :]
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        per_chunk = lambda x: np.bincount(np.searchsorted(ends, x), minlength=len(chunks))
        counts = [per_chunk(x) for x in (ends_a, ends_b, ends_a[last_a], link_ends)]
        codes = a[i] << 32 | b[j]
        while self.n_links + len(codes) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.n_links : self.n_links + len(codes)] = codes
        self.sizes[first : first + len(chunks)] = np.stack([*counts, self.n_links + np.cumsum(counts[3]) - counts[3]], axis=1)
        self.n_links += len(codes)
        # a group's ids of A stand before its ids of B, behind all earlier groups
        text_ids = np.zeros(len(a) + len(b), np.int64)
        before_b, upto_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, side="right")
        text_ids[np.arange(len(a)) + before_b] = 2 * a + last_a
        ended = np.zeros(len(b), np.int64)
        ended[np.cumsum(counts[1]) - 1] = 1
        text_ids[np.arange(len(b)) + upto_a] = 2 * len(self.bytes_a) + 3 * b + last_b + ended
        self.groups += "".join(map(self.written.__getitem__, text_ids.tolist())).split("\n")[:-1]

    def pairs(self, numbers: np.ndarray) -> np.ndarray:
        """All links of chunks."""
        n, start = self.sizes[numbers, 3], self.sizes[numbers, 4]
        return self.links[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def documents(self, texts: list[str | None]):
        """(tokens of A and B, groups, links, digest, distinct pairs, how often) of each text, in order."""
        state = None
        for work in self._groups(texts):
            if len(self.groups) > REMEMBERED or self.n_links > 16 * REMEMBERED:
                self.forget()
            new = list(dict.fromkeys(c for _, part, _ in work for c in part if c not in self.number))
            if new:
                self.learn(new)
            for whole, part, ends in work:
                if state is None:
                    state = [np.zeros(4, np.int64), hashlib.sha256(), [], whole, True]
                if part:
                    numbers = np.array([self.number[c] for c in part])
                    state[0] += self.sizes[numbers, :4].sum(axis=0)
                    state[3] = state[3] and self.sizes[numbers, 0].min() >= 0
                    state[1].update((("" if state[4] else ";") + ";".join(map(self.groups.__getitem__, numbers.tolist()))).encode())
                    state[2].append(np.unique(self.pairs(numbers), return_counts=True))
                    state[4] = False
                if ends:
                    yield self._told(*state[:4])
                    state = None
            for chunk in new:
                if len(chunk) > LONG_CHUNK:
                    del self.number[chunk]

    @staticmethod
    def _told(total, digest, pairs, fine):
        if not fine:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(pairs) > 1:
            codes, place = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            pairs = [(codes, np.bincount(place, weights=np.concatenate([p[1] for p in pairs])).astype(np.int64))]
        return *total.tolist(), digest.hexdigest(), *pairs[0]

    def _groups(self, texts):
        """Lists of (is it a text with tokens, some of its chunks, are they its last) of about GROUP characters."""
        work, size = [], 0
        for text in texts:
            if not text or SPACE in text:
                work.append((False, [], True))
                continue
            part: list[str] = []
            for chunk in self.chunks(text):
                if size > GROUP:
                    yield [*work, (True, part, False)]
                    work, size, part = [], 0, []
                part.append(chunk)
                size += len(chunk) + 1
            work.append((True, part, True))
        if work:
            yield work


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(files: tuple[str, str]) -> Aligner:
    """One for each worker process, which stays between tasks."""
    if files not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[files] = Aligner(*files)
    return _ALIGNERS[files]


def model_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; a pair is a << 32 | b."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        x = aligner(files)
        for batch in batches:
            rows = list(x.documents(batch.column(1).to_pylist()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def alignments(docs: DataFrame, files: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    told = stored(aligned(docs, files or model_files()).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(told.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a_id = F.shiftright("pair", 32).cast("int")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row for each id of A at most
    highest = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    highest[best["a"].to_numpy()] = best["n"].to_numpy()
    limit = 0
    if counts.count() > broadcast_pairs:
        limit = _limit(counts.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n")), broadcast_pairs)
    frequent = counts.where(F.col("n") > limit).toPandas().sort_values("pair")  # broadcast_pairs at most
    shared = spark.sparkContext.broadcast((frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), highest))

    columns = "row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256".split(", ")
    carried = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        codes, n, most = shared.value
        for batch in batches:
            pairs, times = batch.column(7), batch.column(8)
            lengths = np.asarray(pairs.value_lengths(), np.int64)
            flat, often = np.asarray(pairs.flatten()), np.asarray(times.flatten())
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
            known = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            count = np.where(known, n[at], 0) if len(codes) else np.zeros(len(flat), np.int64)
            is_best = known & (count == most[flat >> 32])
            sums = []
            for weight in (often * is_best, often * count):
                total = np.concatenate([[0], np.cumsum(weight)])
                edge = np.concatenate([[0], np.cumsum(lengths)])
                sums.append(pa.array(total[edge[1:]] - total[edge[:-1]], pa.int64()))
            rare = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(lengths)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(x[~known], pa.int64())) for x in (flat, often)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), *sums, *lists], [*columns, "n_best", "count_sum", "rare", "rare_times"])

    both = told.select(*columns, "pairs", "times").mapInArrow(run, f"{carried}, n_best long, count_sum long, rare array<long>, rare_times array<long>")
    if not limit:
        return both.selectExpr(*_SUMS.split(", "))
    both = stored(both, "summed")
    rest = both.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    top = spark.createDataFrame([(k, n) for k, n in enumerate(highest.tolist()) if 0 < n <= limit], "a int, highest long")
    rare = counts.where(F.col("n") <= limit).withColumn("a", a_id).join(F.broadcast(top), "a", "left")
    is_best = F.when(F.col("n") == F.col("highest"), F.col("times")).otherwise(0)
    sums = rest.join(rare, "pair").groupBy("row").agg(F.sum(is_best).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = both.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return both.selectExpr(*_SUMS.split(", "))


def _limit(by_count: DataFrame, most: int) -> int:
    """The least count so that at most ``most`` pairs have a higher one; counts are read from the highest on, ``most`` of them at most."""
    seen = limit = 0
    for n, pairs in by_count.toLocalIterator():
        limit = n
        seen += pairs
        if seen > most:
            break
    return limit
