"""Comparisons of texts as multisets, coverage, and fixpoint polishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let


def _words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0), F.array().cast("array<string>"))


def compared_words(a: Column, b: Column) -> Column:
    """Structs (w, n, m) of each distinct word of text ``a``: how often it and text ``b`` have it.

    Both texts stand in one row, so their words are sorted together there and counted by the places where they change; nothing is shuffled.
    """
    signed = lambda c, side: F.transform(_words(c), lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    starts = lambda xs: F.array_compact(F.transform(xs, lambda x, i: F.when((i == 0) | (F.get(xs, i - 1) != x), i)))

    def runs(v: Column) -> Column:
        end = lambda k: F.coalesce(F.get(v["start"], k + 1), F.size(v["xs"]))
        return F.transform(v["start"], lambda s, k: F.struct(F.get(v["xs"], s)["w"].alias("w"), F.get(v["xs"], s)["side"].alias("side"), (end(k) - s).cast("long").alias("n")))

    def told(v: Column) -> Column:
        before = lambda k: F.get(v["runs"], k - 1)
        m = lambda r, k: F.when((k > 0) & (before(k)["w"] == r["w"]), before(k)["n"]).otherwise(F.lit(0).cast("long"))
        return F.array_compact(F.transform(v["runs"], lambda r, k: F.when(r["side"] == 1, F.struct(r["w"].alias("w"), r["n"].alias("n"), m(r, k).alias("m")))))

    both = F.array_sort(F.concat(signed(b, 0), signed(a, 1)))
    return let({"xs": both}, lambda v: let({"xs": v["xs"], "start": starts(v["xs"])}, lambda v: let({"runs": runs(v)}, told)))


def multiset_difference(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Words that a row's text ``a`` has more often than its text ``b``: (key, w, lost)."""
    words = compared_words(F.col(a), F.col(b))
    lost = F.filter(F.transform(words, lambda x: F.struct(x["w"].alias("w"), (x["n"] - x["m"]).alias("lost"))), lambda x: x["lost"] > 0)
    return rows.select(key, F.explode(lost).alias("x")).select(key, "x.w", "x.lost")


def multiset_recall(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Share of the words of ``a``, as a multiset, that ``b`` has: (key, common, total, recall) of rows whose ``a`` has words."""
    zero = F.struct(F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("total"))
    add = lambda s, x: F.struct((s["common"] + F.least(x["n"], x["m"])).alias("common"), (s["total"] + x["n"]).alias("total"))
    sums = F.aggregate(compared_words(F.col(a), F.col(b)), zero, add)
    # an array of one struct is computed once, however many of its fields are read
    out = rows.select(key, F.explode(F.array(sums)).alias("x")).select(key, "x.common", "x.total").where("total > 0")
    return out.withColumn("recall", F.round(F.col("common") / F.col("total"), 6))


def widespread(words: DataFrame, pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Words that occur on at least ``share`` of a document's pages; words(doc, page, w), pages(doc, n)."""
    spread = words.groupBy("doc", "w").agg(F.countDistinct("page").alias("p")).join(pages, "doc")
    return spread.where(F.col("p") >= share * F.col("n")).select("doc", "w")


def coverage(probes: DataFrame, lines: DataFrame) -> DataFrame:
    """Share of each probe's sentences that occur as lines of a text, by equi-join: probes(id, part), lines(part)."""
    have = lines.select("part").distinct().withColumn("hit", F.lit(1))
    return probes.join(have, "part", "left").groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


def polished(rows: DataFrame, step: Callable[[DataFrame], DataFrame], text: str, passes: int = 3, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Fixpoint of ``step`` over a text column in at most ``passes`` passes; ``passes_done`` counts the changes of each row.

    ``keep(df, name)`` stores a pass where a later one reads it again, e.g. as a table in a shared folder.
    """
    df = rows.withColumn("passes_done", F.lit(0))
    for k in range(passes):
        new = step(df.withColumn("before__", F.col(text)))
        df = new.withColumn("passes_done", F.col("passes_done") + F.when(F.col(text) != F.col("before__"), 1).otherwise(0)).drop("before__")
        if keep is not None:
            df = keep(df, f"pass{k}")
    return df


def page_differs(changed: Column, total: Column, share: float = 0.004) -> Column:
    return changed > share * total


def ocr_routed(n_tess: Column, n_text: Column, missing_share: Column) -> Column:
    """A page goes to recognition: 15 words or more found there, text layer below 0.85 of them, over 0.15 missing."""
    return (n_tess >= 15) & (n_text < 0.85 * n_tess) & (missing_share > 0.15)


def least_bad(candidates: DataFrame, key: str, text: str, bad: str, order: str) -> DataFrame:
    """The candidate of the least badness, the earliest of equals."""
    return candidates.groupBy(key).agg(F.min_by(text, F.struct(bad, order)).alias(text), F.min(bad).alias(bad))


#: Shares of a corpus's rows beyond which it is flagged (fixed values); empty rows are flagged at once.
LIMITS = {"lost": 0.03, "residual": 0.03, "tiny": 0.02, "empty": 0.0}


def corpus_metrics(rows: DataFrame, by: str, lost: Column, residual: Column, tiny: Column, empty: Column) -> DataFrame:
    """(by, n, lost, residual, tiny, empty, flags): counts of each kind and the kinds beyond their LIMITS."""
    kinds = {"lost": lost, "residual": residual, "tiny": tiny, "empty": empty}
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in kinds.items()])
    return out.withColumn("flags", F.array_compact(F.array(*[F.when(F.col(k) > F.col("n") * LIMITS[k], F.lit(k)) for k in kinds])))
