"""Similarity joins by an inverted index over rare words, exact ratios only for candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions import text as X

LEAST_WORD, MOST_TEXTS, TOP = 4, 400, 60
LEAST_RATIO = 0.8


def rare_words(texts: DataFrame, least: int = LEAST_WORD, most: int = MOST_TEXTS) -> DataFrame:
    """(id, w): distinct words of ``least`` letters or more that occur in fewer than ``most`` texts; texts(id, text).

    The bound on a word's texts is part of the operator: words in more texts do not tell similar ones.
    """
    rows = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{least},}}"), 0))).alias("w"))
    keep = rows.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") < most).select("w")
    return rows.join(keep, "w")


def candidates(probes: DataFrame, texts: DataFrame, top: int = TOP, most: int = MOST_TEXTS) -> DataFrame:
    """(probe, id, common, rank): the ``top`` texts by shared rare words for each probe (the operator's blocking)."""
    index = rare_words(texts, most=most)
    asked = probes.select(F.col("id").alias("probe"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{LEAST_WORD},}}"), 0))).alias("w"))
    common = asked.join(index, "w").where("probe <> id").groupBy("probe", "id").agg(F.count("*").alias("common"))
    w = Window.partitionBy("probe").orderBy(F.desc("common"), "id")
    return common.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ratio(a: str, b: str, least: float = 0.0) -> Column:
    """difflib's ratio of two text columns, which Spark has not, in Arrow batches; below ``least`` an upper bound of it may stand."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(i: str, j: str) -> float:
            m = SequenceMatcher(None, i or "", j or "")
            for bound in (m.real_quick_ratio, m.quick_ratio):
                if (most := bound()) < least:
                    return most
            return m.ratio()

        return pd.Series([one(i, j) for i, j in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(batch, DoubleType())(a, b)


def similar(probes: DataFrame, texts: DataFrame, least: float = LEAST_RATIO, most: int = MOST_TEXTS) -> DataFrame:
    """(id, probe, ratio): each text goes to the first probe that is its number variant, else to the first one that is at least so similar.

    Number variants (``functions.text.is_template``) meet by an equi-join with one probe for each template. The others are
    sought among the candidates by rare words, which are a part of the operator: probes that share none with a text, or
    are behind the first TOP by their number, are not asked.
    """
    key = X.digits_key(F.col("text"))
    first = probes.where(X.is_template(F.col("text"))).withColumn("k", key).groupBy("k").agg(F.min(F.struct("id", "text")).alias("p"))
    variants = texts.where(X.is_template(F.col("text"))).withColumn("k", key).join(first, "k").where("id <> p.id")
    variants = variants.select("id", F.col("p.id").alias("probe"), ratio("p.text", "text").alias("ratio"))
    rest = texts.join(variants.select("id"), "id", "left_anti")
    found = candidates(probes, texts, most=most).join(probes.select(F.col("id").alias("probe"), F.col("text").alias("probe_text")), "probe").join(rest.select("id", "text"), "id")
    found = found.withColumn("ratio", ratio("probe_text", "text", least)).where(F.col("ratio") >= least)
    return variants.unionByName(found.groupBy("id").agg(F.min("probe").alias("probe"), F.min_by("ratio", "probe").alias("ratio")))
