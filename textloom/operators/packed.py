"""Rows of a page (or document) as arrays: they are shuffled together and read by numpy page by page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def packed(rows: DataFrame, part: list[str], columns: list[str]) -> DataFrame:
    """Neighbouring rows of one part as one row of arrays: (part, columns); a part has one row or more, by batches and tasks.

    Nothing is shuffled. A row holds no more than an Arrow batch, and columns of arrays take a fraction of their rows' bytes in the shuffle after.
    """

    def pack(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks() if batch.num_rows else None
            if t is None:
                continue
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in part:
                x = batch.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            ends = pa.array(np.append(starts, t.num_rows), pa.int32())
            keys = [batch.column(c).take(pa.array(starts)) for c in part]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(ends, batch.column(c)) for c in columns)], [*part, *columns])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join([f"`{c}` {kind(c)}" for c in part] + [f"`{c}` array<{kind(c)}>" for c in columns])
    return rows.select(*part, *columns).mapInArrow(pack, schema)


#: Rows of whole parts that are looked at together, at least, if there are so many.
TOGETHER = 1 << 18


def together(tables: list[DataFrame], part: str, run, schema: str) -> DataFrame:
    """``run(keys, tables)`` on whole parts, many at a time, with the rows of ``schema``.

    The tables have the column ``part``; they are shuffled by it once, as arrays. ``keys`` are different parts (an array), and each of the tables given to
    ``run`` has its columns and ``of__``, the place of a row's part in ``keys``. Null is a part, too.
    """
    columns = list(dict.fromkeys(c for t in tables for c in t.columns if c != part))
    kinds = {c: next(t.schema[c].dataType.simpleString() for t in tables if c in t.columns) for c in columns}
    dealt = None
    for k, t in enumerate(tables):
        own = packed(t, [part], [c for c in t.columns if c != part])
        rows = own.select(F.col(part), F.lit(k).alias("table__"), *((F.col(c) if c in t.columns else F.lit(None)).cast(f"array<{kinds[c]}>").alias(c) for c in columns))
        dealt = rows if dealt is None else dealt.unionByName(rows)
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def told(t: pa.Table) -> pa.Table:
        keys = t[part].combine_chunks().dictionary_encode(null_encoding="encode")
        side, found = t["table__"].to_numpy(), []
        for k, own in enumerate(tables_columns):
            at = np.flatnonzero(side == k)
            rows = t.take(pa.array(at))
            n = rows[own[0]].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            found.append({"of__": np.repeat(keys.indices.to_numpy().astype(np.int64)[at], n)} | {c: flat(rows, c) for c in own})
        return run(keys.dictionary, found)

    def go(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key, start = t[part].combine_chunks(), 0
            moved = pc.or_(pc.fill_null(pc.not_equal(key[1:], key[:-1]), False), pc.xor(key[1:].is_null(), key[:-1].is_null()))
            new = np.flatnonzero(np.append(True, moved.to_numpy(zero_copy_only=False))) if len(key) else []
            weights = np.zeros(len(key), np.int64)
            for own in tables_columns:
                weights = np.maximum(weights, pc.fill_null(pc.list_value_length(t[own[0]]), 0).to_numpy().astype(np.int64))
            ends = np.append(0, np.cumsum(weights))
            for at in new:
                more = size + ends[at] - ends[start]
                if more >= TOGETHER and (at or held[-1][part][-1].as_py() != key[0].as_py()):
                    yield from told(pa.concat_tables([*held, t.slice(start, at - start)])).to_batches()
                    held, size, start = [], 0, at
            held.append(t.slice(start))
            size += ends[-1] - ends[start]
        if size or any(h.num_rows for h in held):
            yield from told(pa.concat_tables(held)).to_batches()

    tables_columns = [[c for c in t.columns if c != part] for t in tables]
    return dealt.repartition(part).sortWithinPartitions(part).mapInArrow(lambda batches: (b.cast(out) for b in go(batches)), schema)


def flat(t: pa.Table, column: str) -> pa.Array:
    """A column of all arrays of a part, as one array."""
    x = pc.list_flatten(t[column])
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def floats(t: pa.Table, *columns: str) -> list[np.ndarray]:
    return [flat(t, c).to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]


def read_lines(words: list[str], *keys: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words in the order of ``keys``: those of one cell (all keys but the last three) by line, x and id, joined by spaces, lines by line ends.

    Gives the place of each cell's first word, and the texts.
    """
    order = np.lexsort(keys[::-1])
    n = len(order)
    if not n:
        return order, []
    moved = [k[order][1:] != k[order][:-1] for k in keys[:-2]]
    cell = np.append(True, np.logical_or.reduce(moved[:-1])) if len(moved) > 1 else np.append(True, np.zeros(n - 1, bool))
    line = np.append(False, moved[-1]) & ~cell
    out: list[str] = []
    parts = [words[k] for k in order]
    between = np.where(line, "\n", " ").tolist()
    starts = np.flatnonzero(cell)
    several = (np.add.reduceat(line, starts, dtype=np.int64) > 0).tolist()
    for a, b, lines in zip(starts.tolist(), np.append(starts[1:], n).tolist(), several, strict=True):
        if b - a == 1:
            out.append(parts[a])
        elif not lines:
            out.append(" ".join(parts[a:b]))
        else:
            text = [parts[a]]
            for k in range(a + 1, b):
                text.append(between[k])
                text.append(parts[k])
            out.append("".join(text))
    return order[starts], out
