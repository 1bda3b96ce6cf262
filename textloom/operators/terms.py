"""Term mining: n-grams of words broken at capitals, vocabulary of lower-case words, suppression of parts of longer terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_COUNT = 4
LEAST_WORD, LEAST_SINGLE = 4, 6


def words(c: Column) -> Column:
    """Whole words of two letters or more in reading order; words in capitals become a break ``|``."""
    found = F.regexp_extract_all(c, F.lit(r"\p{L}{2,}"), 0)
    return F.transform(found, lambda w: F.when(w == F.upper(w), F.lit("|")).otherwise(F.lower(w)))


def ngrams(texts: DataFrame, stop: list[str], most: int = 3) -> DataFrame:
    """(grams, n): the n-grams of each text, as arrays, without breaks, stop words at the ends, or short words; from texts(text).

    Words are met with those that follow them by shifted arrays, so each is looked at a few times and nothing is cut out.
    """
    rows = texts.select(words(F.col("text")).alias("w"))
    fits = lambda x, least: (x != "|") & (F.length(x) >= least)
    edge = lambda x, least: fits(x, least) & ~x.isin(*stop)
    shifted = lambda k: F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0)))
    made = [F.struct(F.filter("w", lambda x: edge(x, LEAST_SINGLE)).alias("grams"), F.lit(1).alias("n"))]
    led = F.transform("w", lambda x: F.when(edge(x, LEAST_WORD), x))  # gram so far, null if it cannot begin one
    for n in range(2, most + 1):
        ended = F.zip_with(led, shifted(n - 1), lambda g, x: F.when(g.isNotNull() & edge(x, LEAST_WORD), F.concat(g, F.lit(" "), x)))
        made.append(F.struct(F.array_compact(ended).alias("grams"), F.lit(n).alias("n")))
        led = F.zip_with(led, shifted(n - 1), lambda g, x: F.when(g.isNotNull() & fits(x, LEAST_WORD), F.concat(g, F.lit(" "), x)))
    return rows.select(F.explode(F.array(*made)).alias("g")).select("g.grams", "g.n")


def counted(grams: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(gram, n, c, n_texts) of frequent n-grams.

    A text gives each of its n-grams, and each different one again for the number of texts: sums that are added up before the shuffle.
    """
    all_, different = F.struct(F.col("grams").alias("grams"), F.lit(1).alias("c"), F.lit(0).alias("t")), F.struct(F.array_distinct("grams").alias("grams"), F.lit(0).alias("c"), F.lit(1).alias("t"))
    rows = grams.select("n", F.explode(F.array(all_, different)).alias("x")).select("n", "x.c", "x.t", F.explode("x.grams").alias("gram"))
    return rows.groupBy("gram", "n").agg(F.sum("c").alias("c"), F.sum("t").alias("n_texts")).where(F.col("c") >= least)


def unsuppressed(terms: DataFrame) -> DataFrame:
    """Without grams contained in a longer one of about the same count (difference at most max(2, c // 5)).

    A part is a contiguous run of whole words here, so parts meet wholes by an equi-join.
    """
    parts = terms.where("n > 1").select(F.col("c").alias("whole_c"), F.split("gram", " ").alias("w"), F.col("n").alias("whole_n"))
    spread = parts.select("whole_c", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("whole_n") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("whole_n") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))).alias("gram"))
    covered = terms.join(spread.distinct(), "gram").where(F.abs(F.col("c") - F.col("whole_c")) <= F.greatest(F.lit(2), F.floor(F.col("c") / 5)))
    return terms.join(covered.select("gram").distinct(), "gram", "left_anti")


def ranked(terms: DataFrame, top: int = 150) -> DataFrame:
    """The ``top`` terms by count weighted with length (the feature)."""
    weight = F.col("c") * (1 + 0.5 * (F.col("n") - 1))
    return terms.withColumn("weight", weight).orderBy(F.desc("weight"), "gram").limit(top)


def vocabulary(texts: DataFrame, glossary: DataFrame, constant: list[str]) -> DataFrame:
    """Lower-case words of the texts, dictionary words and a constant list; (word, n, caps).

    A lower-case word of at most two occurrences whose capitals occur ten times as often is an abbreviation, unless not ASCII.
    """
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), 0)).alias("w"))
    n = F.sum(F.when(F.col("w") == F.lower("w"), 1).otherwise(0))
    caps = F.sum(F.when((F.col("w") == F.upper("w")) & (F.col("w") != F.lower("w")), 1).otherwise(0))
    counts = found.groupBy(F.lower("w").alias("word")).agg(n.alias("n"), caps.alias("caps")).where("n > 0")
    counts = counts.where(~((F.col("n") <= 2) & (F.col("caps") >= 10 * F.col("n")) & F.col("word").rlike("^[a-z]+$")))
    extra = glossary.select(F.lower("word").alias("word")).union(texts.sparkSession.createDataFrame([(w,) for w in constant], "word string")).distinct()
    return counts.select("word").union(extra).distinct()
