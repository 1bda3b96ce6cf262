"""Headings and lists mended: what only looks like a heading, levels by numbers, captions and tails in lists, marks typed as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of numbers, captions and marks.
NUMBER = r"^\s*(\d+(?:\.\d+)*)\.?(?=[\s\t])"
NUMBER_AND_DOT = r"^\s*(\d+(?:\.\d+)*)(\.?)\s"
CAPTION = r"(?iu)^\s*(?:(?:Рис(?:унок|\.)|Таблица|Figure|Fig\.|Table|Abbildung|Abb\.|Tabelle)\s*\d|\d+\.\s*(?:ábra|táblázat))"
MARK = r"^\s*(\d{1,3}|[A-Za-z]|[ivxIVX]{2,5})(\.\)|[.)])(?=\s|$)\s*"
DASH = r"^\s*[–—\-](?=\s)"
NUMBERED = ("Decimal", "LowerAlpha", "UpperAlpha", "LowerRoman", "UpperRoman")
# End of the fixed values.
LEVELS = 5


def real_headings(blocks: DataFrame) -> DataFrame:
    """Blocks whose kind and level follow what they are: (doc, ord, kind, level) of ``blocks(doc, ord, kind, level, text, bold, lines)``.

    A heading that is not bold throughout and long is a paragraph: from 80 characters or two lines, with a number from 150 or three, or with a
    colon at its end. If a third or more of a document's numbered headings have another level than their number has parts, all of them
    get that level, 6 at most.
    """
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    number = F.regexp_extract("text", NUMBER, 1)
    n, colon = F.length(t), F.endswith(t, F.lit(":"))
    long = F.when(number != "", (n >= 150) | (F.col("lines") >= 3) | colon).otherwise((n >= 80) | (F.col("lines") >= 2) | colon)
    body = (F.col("kind") == "h") & ~F.col("bold") & (t != "") & long
    rows = blocks.withColumns({"kind": F.when(body, "p").otherwise(F.col("kind")), "level": F.when(~body, F.col("level"))})
    depth = F.when((F.col("kind") == "h") & (number != ""), F.size(F.split(number, r"\.")))
    rows = rows.withColumn("depth__", depth)
    w = Window.partitionBy("doc")
    wrong = F.sum(F.when(F.col("depth__").isNotNull() & ~F.col("level").eqNullSafe(F.col("depth__")), 1).otherwise(0)).over(w)
    relevel = F.col("depth__").isNotNull() & (wrong * 3 >= F.count("depth__").over(w))
    return rows.withColumn("level", F.when(relevel, F.least("depth__", F.lit(6))).otherwise(F.col("level"))).drop("depth__")


def counted_headings(headings: DataFrame) -> DataFrame:
    """Adds ``number``, as automatic numbering gives it to ``headings(doc, ord, level, text)``, and ``typed``, the number in the text.

    The count of a level starts anew behind each heading of a higher level; levels beyond LEVELS count as that one.
    """
    o = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = headings.withColumn("lv__", F.least("level", F.lit(LEVELS)))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"above{k}__", F.sum(F.when(F.col("lv__") < k, 1).otherwise(0)).over(o))
    counts = []
    for k in range(1, LEVELS + 1):
        own = Window.partitionBy("doc", f"above{k}__").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        counts.append(F.sum(F.when(F.col("lv__") == k, 1).otherwise(0)).over(own).alias(f"n{k}__"))
    rows = rows.select(*rows.columns, *counts)
    number = F.array_join(F.slice(F.array(*[F.col(f"n{k}__") for k in range(1, LEVELS + 1)]), F.lit(1), F.col("lv__")), ".")
    rows = rows.withColumns({"number": number, "typed": F.regexp_extract("text", NUMBER_AND_DOT, 1)})
    return rows.drop("lv__", *[f"above{k}__" for k in range(1, LEVELS + 1)], *[f"n{k}__" for k in range(1, LEVELS + 1)])


def numbering_styles(headings: DataFrame) -> DataFrame:
    """(doc, automatic, dotted): can automatic numbering give nine tenths of the headings their number, and which levels put a dot behind it."""
    rows = counted_headings(headings).withColumns({"lv": F.least("level", F.lit(LEVELS)), "dot": F.regexp_extract("text", NUMBER_AND_DOT, 2)})
    levels = rows.where("typed <> ''").groupBy("doc", "lv").agg((2 * F.sum(F.when(F.col("dot") == ".", 1).otherwise(0)) > F.count("*")).alias("more")).where("more")
    dotted = levels.groupBy("doc").agg(F.array_sort(F.collect_list("lv")).alias("dotted"))
    whole = rows.groupBy("doc").agg((F.sum(F.when(F.col("typed") == F.col("number"), 1).otherwise(0)) >= 0.9 * F.count("*")).alias("automatic"))
    return whole.join(dotted, "doc", "left").withColumn("dotted", F.coalesce("dotted", F.array().cast("array<int>")))


def captions_unlisted(items: DataFrame) -> DataFrame:
    """Items that are captions leave their list: adds ``caption``, ``part`` and ``number``.

    ``items(doc, list, item, start, text, pictures)`` in the order of ``item``; ``text`` is the first text of the item, ``pictures`` says that only
    pictures stand before it. A list parts around a caption and its numbers go on: ``part`` counts the captions before, ``number`` goes up
    by one for each item that stays.
    """
    o = Window.partitionBy("doc", "list").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    caption = F.col("pictures") & F.col("text").rlike(CAPTION)
    rows = items.withColumn("caption", F.coalesce(caption, F.lit(False)))
    out = F.sum(F.when(F.col("caption"), 1).otherwise(0)).over(o)
    stayed = F.sum(F.when(F.col("caption"), 0).otherwise(1)).over(o)
    return rows.withColumns({"part": F.when(~F.col("caption"), out), "number": F.when(~F.col("caption"), F.col("start") + stayed - 1)})


def _roman(c: Column) -> Column:
    digit = lambda x: F.when(x == "i", 1).when(x == "v", 5).when(x == "x", 10)
    values = F.transform(F.split(F.lower(c), ""), digit)
    return F.aggregate(F.transform(values, lambda v, i: F.when(F.get(values, i + 1) > v, -v).otherwise(v)), F.lit(0), lambda a, v: a + v)


def typed_marks(items: DataFrame) -> DataFrame:
    """(doc, list, kind, suffix) of lists with typed marks; ``items(doc, list, item, text)`` are items of lists that have no numbers of their own.

    All items with a dash make a list of dashes. All items with a mark make a numbered one: digits; Roman numbers 1, 2, 3 and on, of two items
    or more; single small or capital letters; each one more than that before.
    """
    mark = F.regexp_extract("text", MARK, 1)
    rows = items.withColumns({"mark": mark, "suffix": F.regexp_extract("text", MARK, 2), "dash": F.col("text").rlike(DASH)})
    w = Window.partitionBy("doc", "list").orderBy("item")
    letter = F.when(F.length("mark") == 1, F.ascii(F.lower("mark")) - 96)
    values = {
        "Decimal": F.when(F.col("mark").rlike(r"^\d+$"), F.col("mark").cast("int")),
        "LowerRoman": F.when(F.col("mark").rlike("^[ivx]+$"), _roman(F.col("mark"))),
        "UpperRoman": F.when(F.col("mark").rlike("^[IVX]+$"), _roman(F.col("mark"))),
        "LowerAlpha": F.when(F.col("mark").rlike("^[a-z]$"), letter),
        "UpperAlpha": F.when(F.col("mark").rlike("^[A-Z]$"), letter),
    }
    rows = rows.withColumns({**values, "nth": F.row_number().over(w)})
    steps = {f"{k}__": (F.lag(k).over(w) + 1 == F.col(k)) | F.lag("mark").over(w).isNull() for k in values}
    told = rows.withColumns(steps).groupBy("doc", "list").agg(
        F.count("*").alias("n"),
        F.bool_and("dash").alias("dashes"),
        F.min_by("suffix", "item").alias("suffix"),
        *[F.bool_and(F.col(k).isNotNull()).alias(k) for k in values],
        *[F.bool_and(F.coalesce(F.col(f"{k}__"), F.lit(False))).alias(f"{k}__") for k in values],
        *[F.bool_and(F.coalesce(F.col(k) == F.col("nth"), F.lit(False))).alias(f"{k}_") for k in ("LowerRoman", "UpperRoman")],
    )
    many = F.col("n") > 1
    roman = lambda k: F.col(k) & F.col(f"{k}_") & many
    first = F.when(F.col("Decimal"), "Decimal").when(roman("LowerRoman"), "LowerRoman").when(roman("UpperRoman"), "UpperRoman").when(F.col("LowerAlpha"), "LowerAlpha").when(F.col("UpperAlpha"), "UpperAlpha")
    told = told.withColumn("first", first)
    steady = F.coalesce(*[F.when(F.col("first") == k, F.col(f"{k}__")) for k in values])
    kind = F.when(F.col("dashes"), "Dash").when(steady, F.col("first"))
    return told.select("doc", "list", kind.alias("kind"), F.when(~F.col("dashes"), F.col("suffix")).alias("suffix")).where("kind is not null")


def tails_moved(blocks: DataFrame, slack: float = 2.0) -> DataFrame:
    """Adds ``place``: the end of a list's last item that is drawn below the paragraph behind the list goes behind that paragraph.

    ``blocks(doc, ord, list, item, kind, page, top, bottom)``; list and item are null outside of lists. The end is all blocks of the last item, but
    for its first, from which on every one is below the paragraph or on a later page; the block before them has to end above the paragraph
    and the first of them to stand on its page. Paragraphs and headings that follow there and end above it stay before it.
    """
    w = Window.partitionBy("doc").orderBy("ord")
    rows = blocks.withColumn("follow__", F.col("list").isNull() & F.col("kind").isin("p", "h"))
    rows = rows.withColumn("run__", F.last(F.when(~F.col("follow__"), F.col("ord")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.where("list is not null").groupBy("doc", "list").agg(F.max("ord").alias("end__"), F.max_by("item", "ord").alias("item"))
    place = F.struct("page", "top", "bottom")
    nexts = rows.where("follow__").groupBy("doc", F.col("run__").alias("end__")).agg(F.min_by(place, "ord").alias("next__")).where("next__.page is not null and next__.bottom is not null")
    tail = rows.join(ends.join(nexts, ["doc", "end__"]), ["doc", "list", "item"])
    n = F.col("next__")
    after = (F.col("page") > n["page"]) | ((F.col("page") == n["page"]) & (F.col("top") >= n["bottom"] - slack))
    own = Window.partitionBy("doc", "list").orderBy("ord")
    tail = tail.withColumn("after__", F.coalesce(after & F.col("bottom").isNotNull(), F.lit(False)))
    tail = tail.withColumn("from__", F.coalesce(F.max(F.when(~F.col("after__"), F.col("ord"))).over(Window.partitionBy("doc", "list")), F.min("ord").over(Window.partitionBy("doc", "list"))))
    tail = tail.withColumn("before__", F.lag(place).over(own))
    heads = tail.where(F.col("ord") > F.col("from__")).groupBy("doc", "list", "end__").agg(F.min("ord").alias("cut__"), F.min_by(F.struct("before__", "page", "top", "next__"), "ord").alias("h"))
    b, h = F.col("h.before__"), F.col("h")
    fits = (b["page"] == h["next__"]["page"]) & (b["bottom"] <= h["next__"]["top"] + slack) & (h["page"] == h["next__"]["page"])
    heads = heads.where(F.coalesce(fits, F.lit(False))).select("doc", F.col("end__").alias("run__"), "cut__", F.col("h.page").alias("at_page__"), F.col("h.top").alias("at_top__"))
    # paragraphs behind the list up to the first that does not end above the tail
    follow = rows.where("follow__").join(heads, ["doc", "run__"])
    stays = F.coalesce((F.col("page") == F.col("at_page__")) & (F.col("bottom") <= F.col("at_top__") + slack), F.lit(False))
    stop = follow.groupBy("doc", "run__").agg(F.min(F.when(~stays, F.col("ord"))).alias("stop__"), F.max("ord").alias("last__"))
    moved = heads.join(stop, ["doc", "run__"]).select("doc", "run__", "cut__", F.coalesce(F.col("stop__") - 0.5, F.col("last__") + 0.5).alias("to__"))
    spans = rows.join(moved.withColumnRenamed("run__", "end__").join(ends, ["doc", "end__"]).select("doc", "list", "cut__", "to__"), ["doc", "list"], "left")
    key = F.when(F.col("ord") >= F.col("cut__"), F.col("to__")).otherwise(F.col("ord").cast("double"))
    placed = spans.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(key, "ord")) - 1)
    return placed.drop("follow__", "run__", "cut__", "to__")
