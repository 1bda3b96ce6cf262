"""Deterministic rewrites, and the log of the rules that changed a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.references import exchanged, references
from textloom.functions.text import let

#: Entities and what they stand for (fixed values).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def units(c: Column) -> Column:
    """A unit after a number becomes the target's with one space before it; service notes go."""
    bare = let({"c": c}, lambda v: F.when(F.contains(v["c"], F.lit("[")), F.regexp_replace(v["c"], r"\s*\[(?:уточнить|проверено)[^\]]*\]", "")).otherwise(v["c"]))
    return exchanged(bare, [(unit, rf"(?<=[0-9])\s?{unit}(?![\p{{L}}\p{{N}}_/])", f" {target}") for unit, target in sorted(X.UNITS, key=lambda u: -len(u[0]))])


def entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def spaces_before_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+([,.;:!?])(?=\s|$)", "$1")


def straight_quotes(src: Column, c: Column) -> Column:
    """Straight quotes to guillemets, unless the source has straight ones (then they are code)."""
    quoted = F.contains(c, F.lit('"')) & ~F.contains(src, F.lit('"'))
    return F.when(quoted, F.regexp_replace(c, '(?<![=\\p{L}\\p{N}_])"([^"\\n]+)"', "«$1»")).otherwise(c)


def dates_as_source(src: Column, c: Column) -> Column:
    """dd.mm.yyyy in the target becomes yyyy.mm.dd. if the source writes that date so."""
    found = F.regexp_extract_all(src, F.lit(r"[0-9]{4}\.\s?[0-9]{2}\.\s?[0-9]{2}\.?"), 0)

    def back(acc: Column, d: Column) -> Column:
        day = F.regexp_replace(d, r"^([0-9]{4})\.\s?([0-9]{2})\.\s?([0-9]{2})\.?$", "$3.$2.$1")
        return F.replace(acc, day, d)

    return F.aggregate(found, c, back)


def capitals_lowered(src: Column, c: Column) -> Column:
    """Capital words of five letters or more go down if the source has no capital word; the first one keeps its capital."""
    loud = src.rlike(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")
    words = F.split(c, " ")
    lowered = F.transform(words, lambda w, i: F.when(w.rlike(r"^\p{IsCyrillic}{5,}$") & (w == F.upper(w)), F.when(i == 0, F.initcap(w)).otherwise(F.lower(w))).otherwise(w))
    return F.when(loud, c).otherwise(F.array_join(lowered, " "))


STEPS = [
    ("entity", lambda s, c: entities(c)),
    ("reference", lambda s, c: references(c)),
    ("quotes", straight_quotes),
    ("date", dates_as_source),
    ("unit", lambda s, c: units(c)),
    ("space", lambda s, c: spaces_before_marks(c)),
]


def rewritten(pairs: DataFrame, src: str, tgt: str) -> DataFrame:
    """Adds ``fixed`` and ``log``: the rules, in order, that changed the text."""
    df, log = pairs.withColumn("fixed", F.col(tgt)), []
    for name, step in STEPS:
        df = df.withColumn("next__", step(F.col(src), F.col("fixed")))
        df = df.withColumn(f"did_{name}__", F.when(F.col("next__") != F.col("fixed"), name)).withColumn("fixed", F.col("next__")).drop("next__")
        log.append(f"did_{name}__")
    return df.withColumn("log", F.array_compact(F.array(*log))).drop(*log)


def joined_lines(lines: Column) -> Column:
    """Lines to one text: a hyphen before a small letter is glued, else a space; a compound's hyphen stays after a capital or digit.

    Each line is joined to the one before it by what that one ends with, so a text of any number of lines is read once.
    """
    # empty lines behind a compound's hyphen add nothing
    lines = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"([\p{Lu}0-9]-)\n+(?=\n|\z)", "$1"), "\n")
    return X.let({"lines": lines}, lambda v: _joined(v["lines"]))


def _joined(lines: Column) -> Column:
    first = F.array_position(F.transform(lines, lambda x: x != ""), True)
    kept = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    before = F.concat(F.array(F.lit("")), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
    end = lambda x: F.right(x, F.lit(2))
    joint = F.zip_with(before, kept, lambda b, x: F.when(end(b).rlike(r"\p{Ll}-$") & x.rlike(r"^\p{Ll}"), "glue").when(end(b).rlike(r"[\p{Lu}0-9]-$"), "keep").otherwise("space"))
    after = F.concat(F.slice(joint, 2, F.size(joint)), F.array(F.lit("space")))
    bodies = F.zip_with(kept, after, lambda x, j: F.when(j == "glue", F.left(x, F.length(x) - 1)).otherwise(x))
    spaced = F.zip_with(joint, bodies, lambda j, x: F.when(j == "space", F.concat(F.lit(" "), x)).otherwise(x))
    return F.when(first == 0, "").otherwise(F.substr(F.array_join(spaced, ""), F.lit(2)))


def acceptable(old: Column, new: Column, low: float = 0.6, high: float = 1.6) -> Column:
    """A rewrite keeps the marks, keeps the numbers and stays within the length ratio."""
    ratio = F.length(new) / F.greatest(F.length(old), F.lit(1))
    same = F.array_sort(X.marks(old)) == F.array_sort(X.marks(new))
    return same & (F.array_sort(X.numbers(old)) == F.array_sort(X.numbers(new))) & (ratio > low) & (ratio < high)
