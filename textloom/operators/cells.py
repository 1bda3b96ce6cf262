"""Rows of tables brought onto the columns of their frame: surplus cells merged, short rows placed.

A row has ``xs``, the x of its frame's verticals (columns + 1), and ``cells``, structs (x0, x1, text) in order; x0 and x1 are null for an
empty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed costs: a column that nobody takes, a text outside its columns, a column that a cell's text does not reach, a spanned column of an empty cell.
SKIP, OUTSIDE, UNREACHED, EMPTY_SPAN = 25.0, 1000.0, 30.0, 5.0
CELL = "struct<x0:double,x1:double,text:string>"


def _column_of(cell: Column, xs: Column) -> Column:
    """The column of the middle of a cell's text, or null."""
    inner = F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 2, F.lit(0)))
    return F.when(cell["x1"].isNotNull(), F.size(F.filter(inner, lambda x: (cell["x0"] + cell["x1"]) / 2 >= x)))


def merged(rows: DataFrame) -> DataFrame:
    """Rows with more cells than columns: neighbours whose middles lie in one column become one cell.

    A row is left as it is if a cell behind the first has no place, if its columns are not in order, or if it still has too many cells.
    """
    xs, cells = F.col("xs"), F.col("cells")
    columns = F.size(xs) - 1
    rows = rows.withColumn("at__", F.transform(cells, lambda c: _column_of(c, xs)))
    behind = F.slice("at__", F.lit(2), F.greatest(F.size("at__") - 1, F.lit(0)))
    fine = (columns >= 2) & (F.size(cells) > columns) & ~F.exists(behind, lambda x: x.isNull()) & (F.sort_array(behind) == behind)
    start = F.transform("at__", lambda x, i: F.when((i == 0) | F.get("at__", i - 1).isNull() | (F.get("at__", i - 1) != x), i))
    rows = rows.withColumn("from__", F.when(fine, F.array_compact(start)))

    def group(first: Column, k: Column) -> Column:
        end = F.coalesce(F.get("from__", k + 1), F.size(cells))
        own = F.slice(cells, first + 1, end - first)
        place = lambda name: F.filter(F.transform(own, lambda c: c[name]), lambda x: x.isNotNull())
        return F.struct(F.array_min(place("x0")).alias("x0"), F.array_max(place("x1")).alias("x1"), F.array_join(F.transform(own, lambda c: c["text"]), "\n").alias("text"))

    joined = F.transform("from__", group)
    return rows.withColumn("cells", F.when(F.size("from__") <= columns, joined).otherwise(cells)).drop("at__", "from__")


def _cost(cell: Column, xs: Column, first: Column, last: Column) -> Column:
    left, right = F.get(xs, first), F.get(xs, last + 1)
    inside = (left - 3 <= cell["x0"]) & (cell["x1"] <= right + 3)
    spanned = F.slice(xs, first + 2, last - first)
    unreached = F.size(F.filter(spanned, lambda x: cell["x1"] < x + 3)) * UNREACHED
    off = F.least(F.abs((left + right) / 2 - (cell["x0"] + cell["x1"]) / 2), F.abs(cell["x0"] - left - 5))
    placed = F.when(inside, 0.0).otherwise(OUTSIDE) + unreached + off
    return F.when(cell["x0"].isNull(), EMPTY_SPAN * (last - first)).otherwise(placed)


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``spans``, structs (first, last): the columns that each cell takes, at the least cost.

    A fold over the cells keeps, for each column up to which the cells so far reach, the least cost and its spans (of equal costs those that
    start further left); each cell tries every span behind it. Without a frame that fits, without any place, or where the least cost
    is that of a text outside its columns, every cell takes one column and the last one all the rest.
    """
    xs, cells = F.col("xs"), F.col("cells")
    n = F.size(xs) - 1
    way = "struct<cost:double,spans:array<struct<first:int,last:int>>>"
    none = F.lit(None).cast(way)
    start = F.transform(F.sequence(F.lit(0), n), lambda a: F.when(a == 0, F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))).otherwise(none))

    def step(state: Column, cell: Column) -> Column:
        def reach(end: Column) -> Column:  # the cell's last column is end - 1
            def begin(first: Column) -> Column:
                came = F.filter(F.transform(F.slice(state, F.lit(1), first + 1), lambda w, a: F.when(w.isNotNull(), F.struct((w["cost"] + SKIP * (first - a) + _cost(cell, xs, first, end - 1)).alias("cost"), F.concat(w["spans"], F.array(F.struct(first.alias("first"), (end - 1).alias("last")))).alias("spans")))), lambda w: w.isNotNull())
                return F.array_min(came)

            return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), end - 1), begin), lambda w: w.isNotNull()))

        return F.transform(F.sequence(F.lit(0), n), lambda end: F.when(end == 0, none).otherwise(reach(end)).cast(way))

    ends = F.aggregate(cells, start, step)
    best = F.array_min(F.filter(F.transform(ends, lambda w, a: F.when(w.isNotNull(), F.struct((w["cost"] + SKIP * (n - a)).alias("cost"), w["spans"].alias("spans")))), lambda w: w.isNotNull()))
    plain = F.transform(cells, lambda c, i: F.struct(i.alias("first"), F.when(i == F.size(cells) - 1, n - 1).otherwise(i).alias("last")))
    told = (n >= 1) & (F.size(cells) > 0) & (F.size(cells) <= n) & F.exists(cells, lambda c: c["x0"].isNotNull())
    return rows.withColumn("best__", F.when(told, best)).withColumn("spans", F.when(F.col("best__.cost") < OUTSIDE, F.col("best__.spans")).otherwise(plain)).drop("best__")
