"""Formatting of blocks against a profile: rules as rows, joined with facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules: name, the fact that it looks at, how it compares, and how far off is still right (fixed values).
RULES = [
    ("margins", "margin_left", "near", 1.5),
    ("margins", "margin_right", "near", 1.5),
    ("style", "font", "same", 0.0),
    ("style", "size", "near", 0.25),
    ("style", "bold", "same", 0.0),
    ("page_break", "page_break", "same", 0.0),
    ("number_gap", "number_gap", "near", 1.5),
    ("alignment", "alignment", "same", 0.0),
    ("line", "line", "near", 0.6),
    ("item_indent", "item_indent", "near", 0.5),
    ("item_place", "item_place", "near any", 2.0),
    ("captions", "centered", "same", 0.0),
    ("captions", "caption_place", "same", 0.0),
    ("head_row", "head_fill", "same", 0.0),
    ("head_row", "head_kept", "same", 0.0),
    ("table_width", "table_width", "near share", 0.05),
    ("head_rule", "head_rule", "same", 0.0),
    ("centered_lines", "centered_lines", "at least", 0.0),
    ("typed_number", "typed_number", "none", 0.0),
    ("empty_brackets", "empty_brackets", "none", 0.0),
    ("direct", "direct_size", "none", 0.0),
    ("direct", "direct_indent", "none", 0.0),
]
#: An item's number that is typed as text, and brackets that lost their sign (fixed patterns).
TYPED_NUMBER, EMPTY_BRACKETS = r"^\s*(?:\d+|[A-Za-zА-Яа-я])[.)]\s(?![A-Za-zА-Яа-я][.)]\s)", r"\(\s*\)"
#: Beginnings of captions, and where they belong (fixed values).
CAPTIONS = {"Рисунок": "below figure", "Таблица": "above table"}


def text_facts(kind: Column, text: Column) -> Column:
    """Facts that a block's text tells: array of structs (fact, num, text)."""
    fact = lambda name, when, num: F.when(when, F.struct(F.lit(name).alias("fact"), num.cast("double").alias("num"), F.substring(text, 1, 50).alias("text")))
    typed = fact("typed_number", (kind == "item") & text.rlike(TYPED_NUMBER), F.lit(1))
    return F.array_compact(F.array(typed, fact("empty_brackets", text.rlike(EMPTY_BRACKETS), F.lit(1))))


def caption_places(blocks: DataFrame) -> DataFrame:
    """Captions as facts (doc, ord, role, fact, num, text): where they stand beside their figure or table; blocks(doc, ord, kind, text)."""
    w = Window.partitionBy("doc").orderBy("ord")
    rows = blocks.withColumns({"before__": F.lag("kind").over(w), "after__": F.lead("kind").over(w)}).where("kind = 'caption'")
    figure, below = F.startswith("text", F.lit("Рисунок")), F.coalesce(F.col("before__") == "figure", F.lit(False))
    above = F.coalesce(F.col("after__") == "table", F.lit(False))
    place = F.when(figure, F.when(below, "below figure").otherwise("not below figure")).when(F.startswith("text", F.lit("Таблица")), F.when(above, "above table").otherwise("not above table"))
    role = F.when(figure, "figure caption").otherwise("table caption")
    return rows.where(place.isNotNull()).select("doc", "ord", role.alias("role"), F.lit("caption_place").alias("fact"), F.lit(None).cast("double").alias("num"), place.alias("text"))


def usual(facts: DataFrame, weight: str) -> DataFrame:
    """A profile from the facts themselves: of each role and fact the value of the most weight; of equal ones the least number and text."""
    sums = facts.groupBy("doc", "role", "fact", "num", "text").agg(F.sum(weight).alias("w"))
    w = Window.partitionBy("doc", "role", "fact").orderBy(F.desc("w"), F.asc_nulls_first("num"), F.asc_nulls_first("text"))
    return sums.withColumn("r__", F.row_number().over(w)).where("r__ = 1").select("doc", "role", "fact", "num", "text")


def violations(facts: DataFrame, profile: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(doc, ord, rule, fact, was, need) of the facts that break a rule.

    ``facts(doc, ord, role, fact, num, text)``, ``profile(doc, role, fact, num, text)`` and optionally ``unit``, the width of which ``near share``
    takes its share. A rule that compares needs a row of the profile for the block's role, several for ``near any``; without one it says
    nothing. A fact of a rule ``none`` is a breach by itself. A missing number is never near.
    """
    spark = facts.sparkSession
    told = spark.createDataFrame(rules, "rule string, fact string, how string, off double")
    unit = F.col("unit") if "unit" in profile.columns else F.lit(None).cast("double").alias("unit")
    wanted = profile.select("doc", "role", "fact", F.struct("num", "text", unit.alias("unit")).alias("p")).groupBy("doc", "role", "fact").agg(F.array_sort(F.collect_set("p")).alias("need"))
    rows = facts.join(F.broadcast(told), "fact").join(wanted, ["doc", "role", "fact"], "left")
    how, num, text, off = F.col("how"), F.col("num"), F.col("text"), F.col("off")

    def right(p: Column) -> Column:
        near = lambda most: F.coalesce(F.abs(num - p["num"]) <= most, F.lit(False))
        same = text.eqNullSafe(p["text"]) & num.eqNullSafe(p["num"])
        return F.when(how == "same", same).when(how == "at least", F.coalesce(num >= p["num"], F.lit(False))).when(how == "near share", near(off * p["unit"])).otherwise(near(off))

    first = F.get("need", 0)
    fine = F.when(how == "none", False).when(F.col("need").isNull(), True).when(how == "near any", F.exists("need", right)).otherwise(right(first))
    shown = lambda n, t: F.when(n.isNull(), t).otherwise(F.round(n, 2).cast("string"))
    need = F.when(how == "none", F.lit(None)).when(how == "near any", F.array_join(F.transform("need", lambda p: shown(p["num"], p["text"])), " ")).otherwise(shown(first["num"], first["text"]))
    return rows.where(~fine).select("doc", "ord", "rule", "fact", F.when(how == "none", text).otherwise(shown(num, text)).alias("was"), need.alias("need"))
