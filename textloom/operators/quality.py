"""Reports: summaries, class counts, rates by month and version, vote thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ["edited", "error", "suspect", "auto", "term", "ok"]


def row_class(edited: Column, issues: Column, serious: Column, auto: Column, term: Column) -> Column:
    """First that holds: edited, error, suspect, auto, term, else ok."""
    return F.when(edited, "edited").when(issues > 0, "error").when(serious, "suspect").when(auto, "auto").when(term, "term").otherwise("ok")


def class_counts(rows: DataFrame, by: str, kind: str = "kind") -> DataFrame:
    """Counts of every class for every ``by``, zero where none."""
    counts = [F.sum(F.when(F.col(kind) == c, 1).otherwise(0)).alias(c) for c in CLASSES]
    wide = rows.groupBy(by).agg(*counts)
    return wide.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in CLASSES])).alias("x")).select(by, "x.kind", "x.n")


def distinct_edits(edits: DataFrame) -> DataFrame:
    """Edited places of each job, each once: (job, n)."""
    return edits.groupBy("job").agg(F.countDistinct("doc", "seg").alias("n"))


def rates(jobs: DataFrame, edits: DataFrame, by: Column, name: str) -> DataFrame:
    """Segments, edited places and their rate by month or version: jobs(job, segments, ...)."""
    rows = jobs.join(distinct_edits(edits), "job", "left")
    out = rows.groupBy(by.alias(name)).agg(F.count("*").alias("jobs"), F.sum("segments").alias("segments"), F.sum(F.coalesce("n", F.lit(0))).alias("edited"))
    return out.withColumn("rate", F.round(F.col("edited") / F.greatest("segments", F.lit(1)), 6))


def vote_thresholds(items: DataFrame, most: int) -> DataFrame:
    """items(item, votes, label): for every threshold and label, how many items reach it, of how many."""
    spread = items.select("label", "votes", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("threshold"))
    return spread.groupBy("threshold", "label").agg(F.sum(F.when(F.col("votes") >= F.col("threshold"), 1).otherwise(0)).alias("hits"), F.count("*").alias("total"))


def summary(jobs: DataFrame, by: str) -> DataFrame:
    return jobs.groupBy(by).agg(
        F.count("*").alias("rows"), F.sum(F.when(F.col("copied"), 0).otherwise(1)).alias("translated"), F.sum(F.when(F.col("issues") > 0, 1).otherwise(0)).alias("with_issues"), F.sum(F.when(F.col("suspicious"), 1).otherwise(0)).alias("suspicious")
    )


def ranked_page(rows: DataFrame, order: list[Column], offset: int = 0, size: int = 100) -> DataFrame:
    """One page of a ranking (the feature)."""
    return rows.orderBy(*order).offset(offset).limit(size)


def owned(rows: DataFrame, user: Column, admin: Column) -> DataFrame:
    """Row-level access: the owner's rows, all rows for an administrator."""
    return rows.where((F.col("owner") == user) | admin)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def seldom(places: DataFrame, pages: DataFrame, share: float) -> DataFrame:
    """Images that repeat but stand on at most max(1, share of all pages): (image, pages); places(image, page), pages(page)."""
    n = pages.agg(F.countDistinct("page").alias("all_pages"))
    counts = places.groupBy("image").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n")).where("n > 1")
    return counts.join(F.broadcast(n), F.lit(True)).where(F.col("pages") <= F.greatest(F.lit(1.0), F.col("all_pages") * share)).select("image", "pages")


def voted(cells: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The value with the most weight in each group, the smaller one of equal ones: (by, value, votes)."""
    sums = cells.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    best = F.max_by(value, F.struct("w", (-F.ascii(value)).alias("tie")))
    return sums.groupBy(*by).agg(best.alias(value), F.sum("w").alias("votes"))
