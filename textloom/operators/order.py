"""Order-dependent operators: contexts, islands, gap clusters, packing, medians and modes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators.packed import flat
from textloom.operators.packed import packed as in_arrays


def context(rows: DataFrame, part: str, order: str, clip: int = 400) -> DataFrame:
    """Two rows before and one after, each text clipped."""
    w = Window.partitionBy(part).orderBy(order)
    t = F.substring("text", 1, clip)
    return rows.select(part, order, F.lag(t, 2).over(w).alias("before2"), F.lag(t, 1).over(w).alias("before1"), t.alias("current"), F.lead(t, 1).over(w).alias("after1"))


def section_tail(rows: DataFrame, part: str, order: str, size: int, chars: int) -> DataFrame:
    """Sections of ``size`` rows, each with the last ``chars`` characters of the section before: (part, section, text, tail)."""
    numbered = rows.withColumn("section", F.floor((F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1) / size))
    texts = numbered.groupBy(part, "section").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("t"))
    texts = texts.select(part, "section", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    before = F.lag("text").over(Window.partitionBy(part).orderBy("section"))
    return texts.withColumn("tail", F.coalesce(F.right(before, F.lit(chars)), F.lit("")))


def _sections(limit: int):
    def run(batches):
        for batch in batches:
            out = []
            for lengths in batch.column(2).to_pylist():
                section, used, own = 0, 0, []
                for n in lengths:
                    if used > 0 and used + n > limit:
                        section, used = section + 1, 0
                    used += n
                    own.append(section)
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "s"])

    return run


def packed(rows: DataFrame, part: str, order: str, limit: int) -> DataFrame:
    """Greedy packing in order: a section ends when the next text would pass ``limit``; (part, order, section).

    The lengths of a part's texts, not the texts, are put in order and read once in an Arrow batch.
    """
    lists = rows.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length("text").alias("n")))).alias("t"))
    lists = lists.select(part, F.transform("t", lambda x: x["o"]).alias("o"), F.transform("t", lambda x: x["n"]).alias("n"))
    kind = lambda c: lists.schema[c].dataType.simpleString()
    done = lists.mapInArrow(_sections(limit), f"{part} {kind(part)}, o {kind('o')}, n {kind('n')}, s array<int>")
    return done.select(part, F.explode(F.arrays_zip("o", "n", "s")).alias("x")).select(part, F.col("x.o").alias(order), F.col("x.n").alias("n"), F.col("x.s").alias("section"))


def islands(rows: DataFrame, part: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Adds ``island``: a running number that goes up where ``breaks`` holds."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("break__", F.when(breaks, 1).otherwise(0)).withColumn("island", F.sum("break__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("break__")


def gap_clusters(rows: DataFrame, part: str, value: str, tolerance: float) -> DataFrame:
    """One-dimensional clusters: a gap above ``tolerance`` starts a new one; (part, island, n, low, high, center).

    Values of one bin of that width are always together, so bins are aggregated first and only they are put in order.
    """
    bins = rows.where(F.col(value).isNotNull()).groupBy(part, F.floor(F.col(value) / tolerance).alias("bin__")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("sum__"))
    before = F.lag("high").over(Window.partitionBy(part).orderBy("bin__"))
    marked = islands(bins.withColumn("before__", before), [part], ["bin__"], F.col("low") - F.col("before__") > tolerance)
    sums = marked.groupBy(part, "island").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("sum__").alias("sum__"))
    return sums.select(part, "island", "n", "low", "high", F.round(F.col("sum__") / F.col("n"), 6).alias("center"))


def _label_runs(t: pa.Table, part: list[str], order: str, label: str, schema: pa.Schema) -> pa.Table:
    at = flat(t, order).to_numpy(zero_copy_only=False)
    told = flat(t, label).dictionary_encode(null_encoding="encode")
    kind = told.indices.to_numpy(zero_copy_only=False)
    by = np.lexsort((at, kind))
    at, kind = at[by], kind[by]
    k = at - np.arange(len(at))
    new = np.append(True, (kind[1:] != kind[:-1]) | (k[1:] != k[:-1]))
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(at)))
    labels = told.dictionary.take(pa.array(kind[starts]))
    return pa.Table.from_arrays([*(pa.repeat(t[c][0], len(starts)) for c in part), labels, pa.array(at[starts], schema.field("start").type), pa.array(length, pa.int64())], schema=schema)


def runs(rows: DataFrame, part: list[str], order: str, label: str) -> DataFrame:
    """Runs of consecutive numbers of one label: (part, label, start, length). The numbers are whole, and each occurs once in a part.

    Rows of a part are shuffled and sorted as arrays: a task's memory is that of its numbers and labels, not of rows.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()
    out = ", ".join([*(f"`{c}` {kind(c)}" for c in (*part, label)), f"start {kind(order)}", "length long"])
    schema = to_arrow_schema(T._parse_datatype_string(out))
    return in_arrays(rows, part, [order, label]).groupBy(*part).applyInArrow(lambda t: _label_runs(t, part, order, label, schema), out)


def medians(rows: DataFrame, part: str, value: str) -> DataFrame:
    """Lower, upper and averaged medians."""
    low, high = F.expr(f"percentile_disc(0.5) within group (order by {value})"), F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")
    return rows.groupBy(part).agg(low.alias("lower"), high.alias("upper")).withColumn("middle", F.round((F.col("lower") + F.col("upper")) / 2, 6))


def weighted_mode(rows: DataFrame, part: str, value: str, weight: str) -> DataFrame:
    """The value of the greatest total weight, the smallest of equals; (part, value, weight)."""
    sums = rows.groupBy(part, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(part).agg(F.max_by(value, F.struct("w", F.negative(value))).alias(value), F.max("w").alias("weight"))


def weighted_median(rows: DataFrame, part: str, value: str, weight: str) -> DataFrame:
    """The least value whose running weight reaches half of all."""
    sums = rows.groupBy(part, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(part)
    running = sums.withColumn("run", F.sum("w").over(w.orderBy(value))).withColumn("all", F.sum("w").over(w))
    return running.where(2 * F.col("run") >= F.col("all")).groupBy(part).agg(F.min(value).alias("median"))


def first_use(rows: DataFrame, part: str, order: str, pattern: str) -> DataFrame:
    """The first place of every match of ``pattern`` in its part: (part, hit, first)."""
    hits = rows.select(part, order, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("hit"))
    return hits.groupBy(part, "hit").agg(F.min(order).alias("first"), F.count("*").alias("uses"))


def newest(rows: DataFrame, part: str, order: list[Column], keep: int) -> DataFrame:
    """Newest rows of each part (the feature is the number kept); ``kept`` says which."""
    return rows.withColumn("k__", F.row_number().over(Window.partitionBy(part).orderBy(*order))).withColumn("kept", F.col("k__") <= keep).drop("k__")


def joined_over_pages(rows: DataFrame, doc: str, place: str, page: str, text: str) -> DataFrame:
    """Rows that go on from the last row of a page to the first of the next, as one: (doc, place, n, text).

    A row goes on if it has no closing mark at its end and the next one begins with a small letter.
    """
    w = Window.partitionBy(doc).orderBy(place)
    goes_on = (F.lag(page).over(w) == F.col(page) - 1) & ~F.lag(text).over(w).rlike(r"[.!?:;]\s*$") & F.col(text).rlike(r"^\p{Ll}")
    rows = rows.withColumn("new__", F.when(goes_on, 0).otherwise(1)).withColumn("island__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(place, text)))
    out = rows.groupBy(doc, "island__").agg(parts.alias("parts__"))
    return out.select(doc, F.col("parts__")[0][place].alias(place), F.size("parts__").cast("long").alias("n"), F.array_join(F.transform("parts__", lambda x: x[text]), " ").alias(text))


def page_numbers(rows: DataFrame, doc: str, place: str, ends: Column) -> DataFrame:
    """Adds ``page``: one more than the page ends before the row."""
    w = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("page", (F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(w), F.lit(0)) + 1).cast("int"))
