"""Zones of pages: grids of headers and footers, and the model of a document's pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators.packed import flat, floats, packed, read_lines


#: Values of a cluster of rules' places are at most this apart.
EDGE_GAP = 2.5


def _edges(values: np.ndarray) -> np.ndarray:
    """The first value of every cluster; a value more than EDGE_GAP behind the one before it starts a cluster."""
    v = np.unique(values)
    return v[np.append(True, np.diff(v) > EDGE_GAP)] if len(v) else v


def _place(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interval between neighbouring edges that holds a value, the earlier one of two; -1 outside."""
    return np.where((at >= edges[0]) & (at <= edges[-1]), np.maximum(np.searchsorted(edges, at) - 1, 0), -1)


def _aligned(left: Column, right: Column, width: Column, most: float) -> Column:
    tolerance = F.greatest(F.lit(6.0), 0.05 * width)
    return F.when((right < 10) & (left - 10 > 10), "right").when((F.abs(left - right) < tolerance) & (left > most), "center").otherwise("left")


def _tops(xs: np.ndarray, ys: np.ndarray, hy: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """For each row and column of a grid the row of the horizontal above, which covers half of the column; the first row if none does."""
    rows = len(ys) - 1
    a, b = xs[:-1], xs[1:]
    low, high = np.searchsorted(ys[:-1], hy - 2.0 - 1e-6), np.searchsorted(ys[:-1], hy + 2.0 + 1e-6, side="right")
    n = high - low
    level = np.repeat(np.arange(len(hy)), n)
    row = np.repeat(low, n) + np.arange(len(level)) - np.repeat(np.cumsum(n) - n, n)
    near = np.abs(hy[level] - ys[row]) <= 2
    level, row = level[near], row[near]
    tops = np.zeros((rows, len(a)), np.int64)
    for c in range(len(a)):
        over = np.minimum(h1[level], b[c]) - np.maximum(h0[level], a[c]) >= 0.5 * (b[c] - a[c])
        tops[row[over], c] = row[over]
    return np.maximum.accumulate(tops, axis=0)


_CELLS = "row int, col int, text string, a double, b double, left double, right double, below long"


def _ruled_page(words: pa.Table, rules: pa.Table, schema: pa.Schema) -> pa.Table:
    x0, y0, x1, y1 = floats(rules, "x0", "y0", "x1", "y1")
    up, flat_ = (x1 - x0 < 3) & (y1 - y0 > 5), (y1 - y0 < 3) & (x1 - x0 > 20)
    hy = (y0[flat_] + y1[flat_]) / 2
    xs, ys = _edges((x0[up] + x1[up]) / 2), _edges(hy)
    if not words.num_rows or len(xs) < 3 or len(ys) < 2:
        return schema.empty_table()
    tops = _tops(xs, ys, hy, x0[flat_], x1[flat_])
    wx0, wy0, wx1, wy1 = floats(words, "x0", "y0", "x1", "y1")
    row, col = _place(ys, (wy0 + wy1) / 2), _place(xs, (wx0 + wx1) / 2)
    inside = np.flatnonzero((row >= 0) & (col >= 0))
    row, col, left, right = row[inside], col[inside], wx0[inside], wx1[inside]
    cols = tops.shape[1]
    cell = tops[row, col] * cols + col
    ids, texts = flat(words, "id").to_numpy(zero_copy_only=False)[inside], flat(words, "t").take(pa.array(inside)).to_pylist()
    first, read = read_lines(texts, cell, np.rint(wy0[inside] / 3), left, ids)
    # every cell of the grid, by its first row
    keys, below = np.unique(tops * cols + np.arange(cols), return_counts=True)
    least, most = np.full(len(keys), np.inf), np.full(len(keys), -np.inf)
    at = np.searchsorted(keys, cell)
    np.minimum.at(least, at, left)
    np.maximum.at(most, at, right)
    text = np.full(len(keys), "", object)
    text[at[first]] = read
    none = ~np.isfinite(least)
    k = keys % cols
    page = pa.repeat(words["page"][0], len(keys))
    return pa.Table.from_arrays(
        [page, pa.array(keys // cols, pa.int32()), pa.array(k, pa.int32()), pa.array(text, pa.string()), pa.array(xs[k]), pa.array(xs[k + 1]), pa.array(least, mask=none), pa.array(most, mask=none), pa.array(below - 1, pa.int64())], schema=schema
    )


def ruled_cells(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells (page, row, col, text, align, below) of zones with rules; ``below`` counts the rows that a cell takes beyond its own.

    ``words(page, id, t, box)`` and ``rules(page, box)``: rules less than 3 wide and over 5 high are verticals, those less than 3 high and over 20
    wide horizontals; both are clustered. A zone of two columns and one row or more has a grid: a word lies in the cell of its middle.
    A cell under which no horizontal covers half of its column is one with the cell below. Words are read by lines of 3 points.
    Words and rules of a page are shuffled once, as arrays, and meet there.
    """
    box = ["x0", "y0", "x1", "y1"]
    doubles = [F.col(c).cast("double").alias(c) for c in box]
    kind = words.schema["page"].dataType
    page = kind.simpleString()
    schema = to_arrow_schema(T._parse_datatype_string(f"page {page}, {_CELLS}"))
    w = packed(words.select("page", "id", "t", *doubles), ["page"], ["id", "t", *box])
    r = packed(rules.select(F.col("page").cast(kind).alias("page"), *doubles), ["page"], box)
    out = w.groupBy("page").cogroup(r.groupBy("page")).applyInArrow(lambda a, b: _ruled_page(a, b, schema), f"page {page}, {_CELLS}")
    align = F.when(F.col("left").isNull(), "left").otherwise(_aligned(F.col("left") - F.col("a"), F.col("b") - F.col("right"), F.col("b") - F.col("a"), 8.0))
    return out.select("page", "row", "col", "text", align.alias("align"), "below")


def _rows_of_lines(close: list[bool], have: list[int]) -> np.ndarray:
    """For each line the number of its row; ``have`` are the columns where a line has text, as bits."""
    above, row, out = 0, -1, []
    for near, own in zip(close, have, strict=True):
        # columns of the row above are those of its first line: later lines of a row have text only there
        if not near or own == above or own & ~above:
            above, row = own, row + 1
        out.append(row)
    return np.array(out, np.int64)


def _spaced_page(words: pa.Table, gap: float, schema: pa.Schema) -> pa.Table:
    x0, y0, x1, y1 = floats(words, "x0", "y0", "x1", "y1")
    ids = flat(words, "id").to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, x1, x0))
    reach, start = np.maximum.accumulate(x1[order])[:-1], x0[order][1:]
    apart = start - reach > gap
    cuts = np.sort(np.rint((start[apart] + reach[apart]) / 2))
    col = np.searchsorted(cuts - 2, x0, side="right")
    lines, line = np.unique(np.rint(y0 / 3), return_inverse=True)
    # each line's first word, and the columns that it has
    order = np.lexsort((ids, x0, line))
    first = order[np.append(True, np.diff(line[order]) > 0)]
    close = np.append(False, y0[first][1:] - y0[first][:-1] <= 1.7 * (y1[first][:-1] - y0[first][:-1]))
    have = [0] * len(lines)
    for k in np.unique(line * (len(cuts) + 1) + col).tolist():
        have[k // (len(cuts) + 1)] |= 1 << k % (len(cuts) + 1)
    row = _rows_of_lines(close.tolist(), have)[line]
    first, read = read_lines(flat(words, "t").to_pylist(), row, col, line, x0, ids)
    page = pa.repeat(words["page"][0], len(first))
    return pa.Table.from_arrays([page, pa.array(row[first], pa.int32()), pa.array(col[first], pa.int32()), pa.array(read, pa.string())], schema=schema)


def spaced_cells(words: DataFrame, gap: float = 18.0) -> DataFrame:
    """Cells (page, row, col, text) of zones without rules: columns part where no word is for more than ``gap``, rows are lines of 3 points.

    A line that has text in fewer columns than the row above, only in columns that have text there, and follows within 1.7 of its height, goes
    on with that row's cells. Words of a page are shuffled once, as arrays.
    """
    box = ["x0", "y0", "x1", "y1"]
    out = f"page {words.schema['page'].dataType.simpleString()}, row int, col int, text string"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    w = packed(words.select("page", "id", "t", *[F.col(c).cast("double").alias(c) for c in box]), ["page"], ["id", "t", *box])
    return w.groupBy("page").applyInArrow(lambda t: _spaced_page(t, gap, schema), out)


def page_model(blocks: DataFrame, width: float, signatures: DataFrame) -> DataFrame:
    """The model of each document's pages: (doc, pages, left, right, top, bottom, usual, cover, front, first_page).

    ``blocks(doc, page, x0, x1, top, bottom, chars)``, pages from 1 on; ``signatures(doc, page, key)``: the text of a page's header and footer without numbers.
    The left margin is the least x that three blocks or more share, else the median of the lower half; the right one is what the
    widest block leaves. Top and bottom are the first blocks' tops at one fifth of the pages and the last blocks' bottoms at four fifths. The first
    page is a cover if it has under four tenths of the median page's characters, or if a key that most pages share is not its own. Front
    matter are the pages behind it up to the first one with that key, if they are no more than 3 or 15 in 100. The body starts behind.
    """
    xs = blocks.groupBy("doc", F.rint("x0").alias("x")).agg(F.count("*").alias("n")).where("n >= 3").groupBy("doc").agg(F.min("x").alias("shared"))
    ranked = blocks.withColumns({"r": F.row_number().over(Window.partitionBy("doc").orderBy("x0")) - 1, "n": F.count("*").over(Window.partitionBy("doc"))})
    half = ranked.where(F.col("r") < F.greatest(F.lit(1), F.floor(F.col("n") / 2))).groupBy("doc").agg(F.median("x0").alias("low"))
    sides = blocks.groupBy("doc").agg((width - F.max("x1")).alias("right")).join(xs, "doc", "left").join(half, "doc")
    pages = blocks.groupBy("doc", "page").agg(F.min("top").alias("first"), F.max("bottom").alias("last"), F.sum("chars").alias("chars"))

    def at(share: float, by: str, name: str) -> DataFrame:
        w = Window.partitionBy("doc")
        x = pages.withColumns({"r": F.row_number().over(w.orderBy(by, "page")) - 1, "n": F.count("*").over(w)})
        return x.where(F.col("r") == F.floor(F.col("n") * share)).select("doc", F.col(by).alias(name))

    later = pages.where("page > 1").withColumns({"r": F.row_number().over(Window.partitionBy("doc").orderBy("chars", "page")) - 1, "n": F.count("*").over(Window.partitionBy("doc"))})
    usual = later.where(F.col("r") == F.floor(F.col("n") / 2)).select("doc", F.col("chars").alias("usual"))
    keys = signatures.groupBy("doc", "key").agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("key", F.struct("n", "key")).alias("body"))
    told = signatures.join(keys, "doc").groupBy("doc").agg(
        F.max("page").alias("pages"), F.min(F.when(F.col("page") == 1, F.col("key") == F.col("body"))).alias("own"), F.min(F.when((F.col("page") > 1) & (F.col("key") == F.col("body")), F.col("page"))).alias("back"), F.first("body").alias("body")
    )
    out = sides.join(at(0.2, "first", "top"), "doc").join(at(0.8, "last", "bottom"), "doc").join(usual, "doc", "left").join(told, "doc").join(pages.where("page = 1").select("doc", F.col("chars").alias("chars_1")), "doc", "left")
    thin = F.coalesce((F.col("usual") > 0) & (F.coalesce("chars_1", F.lit(0)) < 0.4 * F.col("usual")), F.lit(False))
    cover = (F.col("pages") > 1) & (thin | ((F.col("body") != "") & ~F.coalesce("own", F.lit(False))))
    before = F.coalesce("back", F.col("pages") + 1) - 2
    front = F.when((F.col("body") != "") & before.between(1, F.greatest(F.lit(3.0), 0.15 * F.col("pages"))), before).otherwise(0)
    out = out.withColumns({"left": F.coalesce("shared", "low"), "cover": cover, "front": front.cast("int")})
    first = F.when(F.col("front") > 0, F.col("front") + 2).when(F.col("cover"), 2).otherwise(1)
    return out.select("doc", "pages", "left", "right", "top", "bottom", "usual", "cover", "front", first.alias("first_page"))
