"""Order of blocks over pages: strays put back, forced page breaks, lists and headings mended.

Blocks are rows (doc, ord, page, ...) in the order of ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(blocks: DataFrame) -> DataFrame:
    """Adds ``run__``, the number of the run of blocks of one page; a block without a page is in the run before it, or in none (0)."""
    w = Window.partitionBy("doc").orderBy("ord")
    before = F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("page").isNotNull() & ~F.coalesce(before == F.col("page"), F.lit(False))
    return blocks.withColumn("new__", new.cast("int")).withColumn("run__", F.sum("new__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")


def reordered(blocks: DataFrame, far: int = 2) -> DataFrame:
    """Strays back to their pages: adds ``place``, the position from 0 on, and ``moved``.

    A run of blocks of one page is a stray if its page is further than ``far`` from the pages of both neighbouring runs and these are in
    order. Strays go, in their order, before the first block that stays whose page is theirs or a later one; before strays of a later
    page that go to the same place, and, among strays of one page with others between, before those that came earlier.
    """
    rows = _runs(blocks)
    runs = rows.where("page is not null").groupBy("doc", "run__").agg(F.first("page").alias("run_page"))
    w = Window.partitionBy("doc").orderBy("run__")
    p, a, b = F.col("run_page"), F.lag("run_page").over(w), F.lead("run_page").over(w)
    runs = runs.withColumn("moved", F.coalesce((F.abs(p - a) > far) & (F.abs(p - b) > far) & (a <= b), F.lit(False)))
    rows = rows.join(runs, ["doc", "run__"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    # the first place of a later or equal page among those that stay
    key = F.when(F.col("moved"), F.col("run_page")).otherwise(F.coalesce("page", F.lit(0)))
    downward = Window.partitionBy("doc").orderBy(F.desc("key__")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("key__", key).withColumn("at__", F.min(F.when(~F.col("moved"), F.col("ord"))).over(downward))
    # moved blocks of one page in a row are a group
    m = Window.partitionBy("doc", "moved").orderBy("ord")
    new = F.coalesce(F.lag("run_page").over(m) != F.col("run_page"), F.lit(True)).cast("int")
    rows = rows.withColumn("group__", F.when(F.col("moved"), new)).withColumn("group__", F.sum("group__").over(m.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lit(2**62)
    order = [
        F.when(F.col("moved"), F.coalesce("at__", last)).otherwise(F.col("ord")),
        F.when(F.col("moved"), 0).otherwise(1),
        F.when(F.col("moved"), F.col("run_page")),
        F.when(F.col("moved"), -F.col("group__")),
        F.col("ord"),
    ]
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1
    return rows.withColumn("place", place).drop("run__", "run_page", "key__", "at__", "group__")


def page_breaks(blocks: DataFrame, gap: float = 72.0, near: int = 4, same: float = 2.0) -> DataFrame:
    """Adds ``break``: a block starts a page of its own accord, not because the last one was full.

    ``blocks(doc, ord, page, kind, top, bottom, first_bottom, look, level, words, end)``; kind is p, h, table, image or toc, first_bottom the bottom
    of a table's first row, look its type's size and weight, end its last character. The usual bottom of a document's pages is their value at
    four fifths. A first block of a page breaks it if the page before ends more than ``gap`` above that, unless a table or image among
    the next ``near`` blocks would not have fitted there. A contents list breaks if no block of its page stands before it. And a
    short paragraph at the head of a page that looks like level-1 headings with breaks, of which there are two or more, does so too.
    """
    pages = blocks.where("page is not null").groupBy("doc", "page").agg(F.min("top").alias("page_top"), F.max("bottom").alias("page_bottom"))
    ranked = pages.withColumns({
        "r__": F.row_number().over(Window.partitionBy("doc").orderBy("page_bottom", "page")) - 1,
        "n__": F.count("*").over(Window.partitionBy("doc")),
    })
    low = ranked.where(F.col("r__") == F.floor(F.col("n__") * 4 / 5)).select("doc", F.col("page_bottom").alias("low"))
    before = pages.select("doc", (F.col("page") + 1).alias("page"), F.col("page_bottom").alias("before"))
    rows = blocks.join(pages.select("doc", "page", "page_top"), ["doc", "page"], "left").join(before, ["doc", "page"], "left").join(low, "doc", "left")
    w = Window.partitionBy("doc").orderBy("ord")
    room = F.col("low") - F.col("before")
    big = F.col("kind").isin("table", "image")
    reach = F.coalesce(F.when(F.col("kind") == "table", F.col("first_bottom")).otherwise(F.col("bottom")), F.lit(0.0))
    rows = rows.withColumn("big__", F.when(big, F.struct("page", reach.alias("to"))))
    ahead = [F.lead("big__", k).over(w) if k else F.col("big__") for k in range(near)]
    rows = rows.withColumn("ahead__", F.try_element_at(F.filter(F.array(*ahead), lambda x: x.isNotNull() & (x["page"] == F.col("page"))), F.lit(1)))
    carried = F.coalesce(F.col("ahead__.to") - F.col("page_top") > room, F.lit(False))
    head = F.abs(F.col("top") - F.col("page_top")) < same
    first = F.col("ord") == F.min("ord").over(Window.partitionBy("doc", "page"))
    by_room = F.when(F.col("kind") == "toc", first & (room > gap)).when(F.col("kind") != "image", head & (room > gap) & ~carried)
    rows = rows.withColumn("break", F.coalesce(by_room, F.lit(False)) & F.col("page").isNotNull())
    return _alike(rows, head, same).drop("page_top", "before", "low", "big__", "ahead__")


def _alike(rows: DataFrame, head: Column, same: float, off: float = 6.0) -> DataFrame:
    """Paragraphs that look like the breaking level-1 headings and stand at their height."""
    tops = rows.where("kind = 'h' and level = 1 and break and top is not null").select("doc", "look", "top")
    many = tops.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 2").select("doc")
    tops = tops.join(many, "doc", "left_semi")
    heights = tops.select("doc", F.col("top").alias("y"), F.explode(F.array(*[F.floor(F.col("top") / off) + k for k in (-1, 0, 1)])).alias("step")).distinct()
    end_ok = ~F.col("end").isin(*".:;,")
    asked = rows.where((F.col("kind") == "p") & ~F.col("break") & head & F.col("words").between(1, 6) & end_ok)
    asked = asked.join(tops.select("doc", "look").distinct(), ["doc", "look"], "left_semi").withColumn("step", F.floor(F.col("top") / off))
    found = asked.join(heights, ["doc", "step"]).where(F.abs(F.col("top") - F.col("y")) < off).select("doc", "ord").distinct().withColumn("alike__", F.lit(True))
    return rows.join(found, ["doc", "ord"], "left").withColumn("break", F.col("break") | F.coalesce("alike__", F.lit(False))).drop("alike__")
