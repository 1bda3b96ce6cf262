"""Translation memories: exact, number-template and priority lookups; upserts and approvals; edits fanned out to equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.scratch import stored


def reuse(segments: DataFrame, key: Column) -> DataFrame:
    """Keys that occur more than once: (k, n_rows, n_docs)."""
    rows = segments.select("doc", key.alias("k")).where("k <> ''")
    return rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.countDistinct("doc").alias("n_docs")).where("n_rows > 1")


def first_wins(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each key's first row; partial aggregation, no window."""
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(*order, value)).alias(value))


def last_wins(rows: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key that is last in ``order`` (approved before own, newest first is a matter of the order)."""
    return rows.groupBy(*key).agg(F.max(F.struct(*dict.fromkeys([*order, *keep]))).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def substituted(template: Column, key_numbers: Column, numbers: Column) -> Column:
    """A template's target with its numbers, in order, replaced by those of another row."""
    parts = F.split(template, "[0-9]+", -1)
    own = X.digit_runs(template)
    new = F.transform(own, lambda x: F.coalesce(F.try_element_at(numbers, F.array_position(key_numbers, x).cast("int")), x))
    joined = F.zip_with(parts, new, lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))
    return F.array_join(joined, "")


def by_template(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets for ``rows(id, src)`` from the first clean pair ``pairs(ord, src, tgt)`` that differs in numbers only."""
    clean = pairs.where(X.is_template(F.col("src")) & (F.array_sort(X.digit_runs(F.col("src"))) == F.array_sort(X.digit_runs(F.col("tgt")))))
    first = clean.groupBy(X.digits_key(F.col("src")).alias("k")).agg(F.min(F.struct("ord", "src", "tgt")).alias("t"))
    probes = rows.where(X.is_template(F.col("src"))).withColumn("k", X.digits_key(F.col("src")))
    got = substituted(F.col("t.tgt"), X.digit_runs(F.col("t.src")), X.digit_runs(F.col("src")))
    return probes.join(first, "k").select("id", "src", got.alias("tgt"))


def looked_up(rows: DataFrame, tm: DataFrame, memory: DataFrame, templates: DataFrame) -> DataFrame:
    """Priority lookup of ``rows(id, k, tk)``: memory of the project, exact memory, number template. All are keyed tables (k, tgt)."""
    out = rows.join(tm.select("k", F.col("tgt").alias("tm_tgt")), "k", "left").join(memory.select("k", F.col("tgt").alias("memory_tgt")), "k", "left")
    out = out.join(templates.select(F.col("k").alias("tk"), F.col("tgt").alias("template_tgt")), "tk", "left")
    found = F.coalesce("tm_tgt", "memory_tgt", "template_tgt")
    origin = F.when(F.col("tm_tgt").isNotNull(), "tm").when(F.col("memory_tgt").isNotNull(), "memory").when(F.col("template_tgt").isNotNull(), "template").otherwise("none")
    return out.select("id", found.alias("tgt"), origin.alias("origin"))


def misses(rows: DataFrame, memory: DataFrame, key: str = "k") -> DataFrame:
    return rows.join(memory.select(key).distinct(), key, "left_anti")


def upserted(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Latest row for each unique key: on conflict the newer one's values."""
    return last_wins(rows, key, order, values)


def approved(rows: DataFrame, key: list[str], decision: str, id_: str) -> DataFrame:
    """Approve the smallest id of each key that ``decision`` marks; its rivals are rejected, other keys stay as they were."""
    chosen = rows.where(decision).groupBy(*key).agg(F.min(id_).alias("approved_id"))
    status = F.when(F.col("approved_id").isNull(), "draft").when(F.col(id_) == F.col("approved_id"), "approved").otherwise("rejected")
    return rows.join(chosen, key, "left").withColumn("status", status).drop("approved_id")


def fanned_out(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Every segment whose memory key equals that of an edit ``edits(k, edited)`` gets it; others keep their text."""
    rows = segments.withColumn("k", X.tm_key(F.col("text")))
    return rows.join(edits, "k", "left").withColumn("final", F.coalesce("edited", "text")).withColumn("was_edited", F.col("edited").isNotNull())


def pending(edits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first 'before' and the last 'after'."""
    o = F.struct(*order)
    return edits.groupBy(*key).agg(F.min_by("before", o).alias("before"), F.max_by("after", o).alias("after"), F.count("*").alias("n_edits"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Source keys with more than one target: variants and degree; (k, tgt, author)."""
    return rows.groupBy("k").agg(F.countDistinct("tgt").alias("degree"), F.array_sort(F.collect_set("tgt")).alias("variants")).where("degree > 1")


def unique_names(files: DataFrame) -> DataFrame:
    """Base names of uploads; the k-th repetition gets `` (k)``. ``files(job, ord, path)``."""
    rows = files.withColumn("name", X.base_name(F.col("path")))
    k = F.row_number().over(Window.partitionBy("job", "name").orderBy("ord"))
    return rows.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("k").cast("string"), F.lit(")")))).drop("k")


def digest(c: Column) -> Column:
    """128 bits that stand for a text of any length in shuffles."""
    return F.unhex(F.md5(c))


def consecutive(rows: DataFrame, part: str, order: str, key: str, most: int = 10) -> DataFrame:
    """Digests of the keys of 1 to ``most`` consecutive rows of a part, put together: (part, place, digests), ``place`` the row's own from 1."""
    w = Window.partitionBy(part).orderBy(order)
    lists = rows.select(part, F.row_number().over(w).alias("place"), F.collect_list(key).over(w.rowsBetween(0, most - 1)).alias("keys"))
    return lists.select(part, "place", F.transform(F.sequence(F.lit(1), F.size("keys")), lambda n: digest(F.array_join(F.slice("keys", 1, n), ""))).alias("digests"))


def cascaded(ours: DataFrame, theirs: DataFrame, part: str, order: str, key: str, most: int = 10) -> DataFrame:
    """How each of our rows meets theirs of the same part: ``exact`` by key, else ``joined`` as 2 to ``most`` consecutive ones of theirs,
    else ``part`` as one of 2 to ``most`` consecutive ones of ours that make up one of theirs, else ``own``. Runs are never written out
    as texts: their digests meet in one equi-join.
    """
    mine = stored(consecutive(ours, part, order, key, most), "runs")
    runs = lambda df: df.select(part, "place", F.posexplode("digests").alias("n", "digest"))
    known = runs(consecutive(theirs, part, order, key, most)).groupBy(part, "digest").agg(F.bool_or(F.col("n") == 0).alias("single"), F.bool_or(F.col("n") > 0).alias("joined"))
    met = runs(mine).join(known, [part, "digest"]).where("n = 0 or single")
    rank = F.when(F.col("n") > 0, 3).when(F.col("single"), 1).otherwise(2)
    best = met.select(part, rank.alias("rank"), F.explode(F.sequence("place", F.col("place") + F.col("n"))).alias("place")).groupBy(part, "place").agg(F.min("rank").alias("rank"))
    how = F.coalesce(F.get(F.array(*map(F.lit, ("exact", "joined", "part"))), F.col("rank") - 1), F.lit("own"))
    return mine.select(part, "place").join(best, [part, "place"], "left").select(part, "place", how.alias("how"))
