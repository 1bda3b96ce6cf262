"""Boxes on pages: overlaps, containment, gaps, reading order, grids. Rows are (page, id, x0, y0, x1, y1)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators.graph import components
from textloom.operators.packed import flat, floats, packed, together
from textloom.sources.scratch import stored

#: Height of the blocks of a page whose boxes one task links, and how many pairs it looks at together.
BLOCK, PAIRS = 2400.0, 1 << 20


def token_boxes(texts: DataFrame, per_line: int = 8, char: float = 6.0, line: float = 12.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Boxes derived from texts(page, text): words laid out ``per_line`` to a line, one column each; (page, id, line, t, box, kept columns)."""
    rows = texts.select("page", *keep, F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("id", "t"))
    x0 = (F.col("id") % per_line) * 60.0 + F.pmod(F.length("t") * 7, F.lit(11))
    row = F.floor(F.col("id") / per_line)
    y0 = row * line + F.pmod(F.length("t"), F.lit(3))
    return rows.select("page", "id", row.alias("line"), "t", x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + F.length("t") * char).alias("x1"), (y0 + 10.0).alias("y1"), *keep)


def buckets(boxes: DataFrame, size: float) -> DataFrame:
    """Each box in every horizontal band it touches, so that overlaps become equi-joins on (page, band)."""
    return boxes.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))


def overlaps(boxes: DataFrame, share: float = 0.25, band: float = 24.0) -> DataFrame:
    """Pairs a < b of one page that overlap by more than ``share`` of the smaller's area: (page, a, b, area)."""
    a, b = buckets(boxes, band).alias("a"), buckets(boxes, band).alias("b")
    w = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    h = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    size = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    met = (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & (w > 0) & (h > 0)
    first_band = F.col("a.band") == F.greatest(F.floor(F.col("a.y0") / band), F.floor(F.col("b.y0") / band))
    rows = a.join(b, met & first_band).select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), (w * h).alias("area"), F.least(size("a"), size("b")).alias("smaller"))
    return rows.where(F.col("area") > share * F.col("smaller")).select("page", "a", "b", F.round("area", 6).alias("area"))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six places as Spark's round has them: halves of the number as it is written go away from zero."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    unsure = (np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-3) | (np.abs(scaled) > 2**50)
    for k in np.flatnonzero(unsure & (x != np.rint(x))):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    whole = x == np.rint(x)
    out[whole] = x[whole]
    return out


def _in_bands(y0: np.ndarray, y1: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Each box (its place) in every band that it touches."""
    first, last = np.floor(y0 / band).astype(np.int64), np.floor(y1 / band).astype(np.int64)
    n = np.maximum(last - first + 1, 0)
    at = np.repeat(np.arange(len(y0)), n)
    return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def band_pairs(of_a: np.ndarray, ay0, ay1, of_b: np.ndarray, by0, by1, band: float):
    """Places of boxes a and b of one page (their numbers ``of``) that have a band in common, each pair once, about PAIRS at a time."""
    i, band_a = _in_bands(ay0, ay1, band)
    j, band_b = _in_bands(by0, by1, band)
    if not len(i) or not len(j):
        return
    low = min(band_a.min(), band_b.min())
    high = max(band_a.max(), band_b.max()) - low + 1
    key_a, key_b = of_a[i] * high + band_a - low, of_b[j] * high + band_b - low
    order = np.argsort(key_b, kind="stable")
    j, key_b = j[order], key_b[order]
    first, last = np.searchsorted(key_b, key_a), np.searchsorted(key_b, key_a, side="right")
    ends, start = np.cumsum(last - first), 0
    while start < len(i):  # runs of boxes with about PAIRS others in their bands
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        n = (last - first)[start:stop]
        a, b = np.repeat(i[start:stop], n), j[np.repeat(first[start:stop], n) + _ranges(n)]
        once = np.repeat(band_a[start:stop], n) == np.maximum(np.floor(ay0[a] / band), np.floor(by0[b] / band))
        yield a[once], b[once]
        start = stop


def _best_lines(boxes: pa.Table, lines: pa.Table, share: float, band: float, schema: pa.Schema) -> pa.Table:
    if not boxes.num_rows or not lines.num_rows:
        return schema.empty_table()
    ax0, ay0, ax1, ay1 = floats(boxes, "x0", "y0", "x1", "y1")
    bx0, by0, bx1, by1 = floats(lines, "x0", "y0", "x1", "y1")
    ids, names = (flat(t, "id").to_numpy(zero_copy_only=False) for t in (boxes, lines))
    a, band_a = _in_bands(ay0, ay1, band)
    b, band_b = _in_bands(by0, by1, band)
    order = np.argsort(band_b, kind="stable")
    b, band_b = b[order], band_b[order]
    low, high = np.searchsorted(band_b, band_a), np.searchsorted(band_b, band_a, side="right")
    ends = np.cumsum(high - low)
    found: list[tuple] = []
    start = 0
    while start < len(a):  # runs of boxes with about PAIRS lines in their bands
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = (high - low)[start:stop]
        i = np.repeat(a[start:stop], n)
        j = b[np.repeat(low[start:stop], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        w, h = np.minimum(ax1[i], bx1[j]) - np.maximum(ax0[i], bx0[j]), np.minimum(ay1[i], by1[j]) - np.maximum(ay0[i], by0[j])
        met = (w > 0) & (h > share * (ay1 - ay0)[i])
        found.append(_largest(ids[i[met]], names[j[met]], _rounded((w * h)[met])))
        start = stop
    box, line, area = _largest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (ids[:0], names[:0], ax0[:0])
    kinds = [schema.field(c).type for c in ("id", "line")]
    return pa.Table.from_arrays([pa.repeat(boxes["page"][0], len(box)), pa.array(box, kinds[0]), pa.array(line, kinds[1]), pa.array(area, pa.float64())], schema=schema)


def _largest(box: np.ndarray, line: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each box the line of the largest area, the smallest of equals."""
    order = np.lexsort((line, -area, box))
    first = order[np.append(True, np.diff(box[order]) != 0)] if len(order) else order
    return box[first], line[first], area[first]


def best_line(boxes: DataFrame, lines: DataFrame, share: float = 0.4, band: float = 24.0) -> DataFrame:
    """The line that each box overlaps most, by more than ``share`` of its height: (page, id, line, area).

    Boxes and lines of a page are shuffled once, as arrays, and meet there by bands.
    """
    box = ["x0", "y0", "x1", "y1"]
    kind = boxes.schema["page"].dataType
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    out = f"page {kind.simpleString()}, id {boxes.schema['id'].dataType.simpleString()}, line {lines.schema['id'].dataType.simpleString()}, area double"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    a, b = (packed(x.where(whole).select(F.col("page").cast(kind).alias("page"), "id", *[F.col(c).cast("double").alias(c) for c in box]), ["page"], ["id", *box]) for x in (boxes, lines))
    return a.groupBy("page").cogroup(b.groupBy("page")).applyInArrow(lambda x, y: _best_lines(x, y, share, band, schema), out)


def line_groups(boxes: DataFrame, gap: float = 30.0) -> DataFrame:
    """Boxes of a line in x order join while the gap is at most ``gap``: (page, line, island, n, text, x0, x1)."""
    w = Window.partitionBy("page", "line").orderBy("x0", "id")
    far = F.col("x0") - F.lag("x1").over(w) > gap
    rows = boxes.withColumn("far", F.when(far, 1).otherwise(0)).withColumn("island", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("page", "line", "island").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("x0", "id", "t"))).alias("t"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return out.withColumn("text", F.array_join(F.transform("t", lambda x: x["t"]), " ")).drop("t")


def widest_gaps(boxes: DataFrame, size: float, ratio: float) -> DataFrame:
    """Lines whose widest gap is at least ``size`` and ``ratio`` times the second widest: (page, line, gap, second)."""
    w = Window.partitionBy("page", "line").orderBy("x0", "id")
    gaps = boxes.withColumn("gap", F.lead("x0").over(w) - F.col("x1")).where("gap is not null")
    rows = gaps.groupBy("page", "line").agg(F.slice(F.sort_array(F.collect_list("gap"), asc=False), 1, 2).alias("g"))
    rows = rows.select("page", "line", F.get("g", 0).alias("gap"), F.coalesce(F.get("g", 1), F.lit(0.0)).alias("second"))
    return rows.where((F.col("gap") >= size) & (F.col("gap") >= ratio * F.col("second"))).select("page", "line", F.round("gap", 6).alias("gap"), F.round("second", 6).alias("second"))


def reading_order(blocks: DataFrame, middle: float, wide: float) -> DataFrame:
    """Full-width blocks start bands; inside a band the left side is read before the right: adds ``band``, ``side``, ``ord``."""
    w = Window.partitionBy("page").orderBy("y0", "x0", "id")
    full = F.col("x1") - F.col("x0") >= wide
    rows = blocks.withColumn("band", F.sum(F.when(full, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("side", F.when(full, 0).when(F.col("x0") < middle, 1).otherwise(2))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("band", "side", "y0", "x0", "id")))


def contained(boxes: DataFrame, cells: DataFrame, band: float = 24.0) -> DataFrame:
    """The smallest cell that holds a box's centre: (page, id, cell)."""
    cx, cy = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("a.y0") + F.col("a.y1")) / 2
    a, b = boxes.withColumn("band", F.floor((F.col("y0") + F.col("y1")) / 2 / band)).alias("a"), buckets(cells, band).alias("b")
    met = (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.y0"), F.col("b.y1"))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    rows = a.join(b, met).select(F.col("a.page").alias("page"), F.col("a.id").alias("id"), F.col("b.id").alias("cell"), area.alias("area"))
    return rows.groupBy("page", "id").agg(F.min_by("cell", F.struct("area", "cell")).alias("cell"))


def unions(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Bounding boxes."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def free_width(boxes: DataFrame, page_width: float) -> DataFrame:
    """Room to the right of each box up to the next one of its line or the page's edge."""
    nxt = F.lead("x0").over(Window.partitionBy("page", "line").orderBy("x0", "id"))
    return boxes.select("page", "line", "id", F.round(F.coalesce(nxt, F.lit(page_width)) - F.col("x0"), 6).alias("room"))


def touching(rules: DataFrame, reach: float = 2.0, band: float = 24.0) -> DataFrame:
    """Pairs of rules (boxes) of a page that touch within ``reach``: (page, a, b); an equi-join on page and band."""
    rows = buckets(rules.withColumn("y1", F.col("y1") + reach), band)
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.page") == F.col("b.page")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id"))
    met = met & (F.col("a.x0") <= F.col("b.x1") + reach) & (F.col("b.x0") <= F.col("a.x1") + reach) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    first_band = F.col("a.band") == F.floor(F.greatest("a.y0", "b.y0") / band)
    return a.join(b, met & first_band).select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def linked(x0, y0, x1, y1, reach: float, of: np.ndarray | None = None) -> np.ndarray:
    """For boxes in order of ``y0`` the first of those that they are linked with, through any number of boxes that touch within ``reach``.

    With ``of``, the numbers of pages, boxes are in order of page and ``y0``, and only those of one page are linked.
    """
    low = np.arange(len(y0))
    if of is None:
        last = np.searchsorted(y0, y1 + reach, side="right")
    else:  # how many boxes begin before the end of each, among beginnings and ends in order
        both = np.concatenate([y0, y1 + reach])
        order = np.lexsort((np.repeat([False, True], len(y0)), both, np.concatenate([of, of])))
        last = np.empty(len(y0), np.int64)
        ends = order >= len(y0)
        last[order[ends] - len(y0)] = np.cumsum(~ends)[ends]
    ends = np.cumsum(np.maximum(last - low - 1, 0))
    a, b = [], []
    start = 0
    while start < len(y0):  # runs of boxes with about PAIRS boxes that begin before they end
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        n = np.maximum(last[start:stop] - low[start:stop] - 1, 0)
        i = np.repeat(low[start:stop], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        met = (x0[i] <= x1[j] + reach) & (x0[j] <= x1[i] + reach) & (y0[i] <= y1[j] + reach)
        a.append(i[met])
        b.append(j[met])
        start = stop
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
    while len(a):  # roots of linked boxes hook onto the smaller one, then every box looks up its root
        np.minimum.at(low, np.maximum(low[a], low[b]), np.minimum(low[a], low[b]))
        while not np.array_equal(low[low], low):
            low = low[low]
        apart = low[a] != low[b]
        a, b = a[apart], b[apart]
    return low


def _block_roots(reach: float):
    """For the rules of each block of whole pages the least id of those that they are linked with there."""

    def run(keys: pa.Array, found: list[dict]) -> pa.Table:
        t = found[0]
        block, ids, *box = (t[c].to_numpy(zero_copy_only=False) for c in ("block", "id", "x0", "y0", "x1", "y1"))
        order = np.lexsort((box[1], block, t["of__"]))
        page, block, ids = t["of__"][order], block[order], ids[order]
        new = np.append(False, (page[1:] != page[:-1]) | (block[1:] != block[:-1])) if len(order) else np.zeros(0, bool)
        low = linked(*(c[order] for c in box), reach, np.cumsum(new))
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, low, ids)
        return pa.table({"page": keys.take(pa.array(page)), "id": ids, "home": t["home"].take(pa.array(order)), "root": least[low]})

    return run


def grids(rules: DataFrame, reach: float = 2.0) -> DataFrame:
    """Connected groups of touching rules: (page, id, grid), the smallest id of the group.

    Rules are linked in blocks of a page, each in those that it reaches into; what a rule is linked with in its first block and in others is
    then one group: only such links between blocks are closed by star rounds on (page, id). Rules without a box are groups of their own.
    """
    kind = rules.schema["id"].dataType
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    first, last = F.floor(F.col("y0") / BLOCK), F.floor((F.col("y1") + reach) / BLOCK)
    rows = rules.where(whole).select("page", F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), first.alias("first"), F.explode(F.sequence(first, F.greatest(first, last))).alias("block"))
    rows = rows.select("page", "block", "id", "x0", "y0", "x1", "y1", (F.col("first") == F.col("block")).alias("home"))
    page = rules.schema["page"].dataType.simpleString()
    found = stored(together([rows], "page", _block_roots(reach), f"page {page}, id long, home boolean, root long"), "blocks")
    own = found.where("home").select("page", "id", "root")
    met = found.where("not home").select("page", "id", F.col("root").alias("other")).join(own, ["page", "id"]).where("root <> other")
    node = lambda c: F.struct("page", F.col(c).alias("id"))
    roots = components(met.select(node("root").alias("a"), node("other").alias("b")))
    roots = roots.select(F.col("node.page").alias("page"), F.col("node.id").alias("root"), F.col("root.id").alias("grid"))
    out = own.join(roots, ["page", "root"], "left").select("page", F.col("id").cast(kind).alias("id"), F.coalesce("grid", "root").cast(kind).alias("grid"))
    return out.unionByName(rules.where(~whole).select("page", "id", F.col("id").alias("grid")))
