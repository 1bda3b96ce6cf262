"""Dictionaries: phrase matches by blocked stems, misses, layers, merging of candidates, diffs and versions.

Matching is blocked by the first word's key and verified by joins of word positions; the dictionary is a table, broadcast only
if Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.morphology import matches_word

WINDOW_EXTRA = 2
HIT_LIMIT = 90
#: A dictionary of up to this number of entries is broadcast.
BROADCAST_ENTRIES = 50_000
STEM = 4


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def stem_key(w: Column, n: int = STEM) -> Column:
    """Blocking key of a word: its first letters; short and digit-bearing words stay whole."""
    return F.when(w.rlike("[0-9]") | (F.length(w) <= n), w).otherwise(F.substring(w, 1, n))


def positions(texts: DataFrame) -> DataFrame:
    """(id, i, w) for texts(id, text)."""
    return texts.select("id", F.posexplode(words(F.col("text"))).alias("i", "w"))


def phrase_hits(texts: DataFrame, entries: DataFrame, inflected: bool = False) -> DataFrame:
    """Contiguous matches of ``entries(entry, term)``: (id, entry, i, j), words equal by stem key.

    Up to BROADCAST_ENTRIES entries (counted) are broadcast and texts stay where they are. Beyond that each entry word is matched
    by an equi-join on key, and a run counts if all its words start at one place: no pairs of
    texts and entries are made that share nothing. ``inflected`` blocks by three letters and then asks that the text's word is the
    term's stem with an ending or a chain of suffixes.
    """
    if inflected:
        stem = lambda w: F.substring(w, 1, 3)
        parts = entries.select("entry", F.size(words(F.col("term"))).alias("n"), F.posexplode(words(F.col("term"))).alias("k", "tw")).withColumn("key", stem("tw"))
        met = positions(texts).withColumn("key", stem("w")).join(parts, "key").where(matches_word(F.col("tw"), F.col("w")))
        runs = met.groupBy("id", "entry", (F.col("i") - F.col("k")).alias("i"), "n").agg(F.countDistinct("k").alias("got"))
        return runs.where("got = n and i >= 0").select("id", "entry", "i", (F.col("i") + F.col("n")).alias("j"))
    if entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        # A small dictionary goes to the texts: its first words find places, and the rest is compared inside the row.
        terms = entries.select("entry", F.transform(words(F.col("term")), lambda w: stem_key(w)).alias("seq")).where("size(seq) > 0").select("entry", "seq", F.col("seq")[0].alias("key"))
        rows = texts.select("id", F.transform(words(F.col("text")), lambda w: stem_key(w)).alias("keys"))
        met = rows.select("id", "keys", F.posexplode("keys").alias("i", "key")).join(F.broadcast(terms), "key")
        return met.where(F.slice("keys", F.col("i") + 1, F.size("seq")) == F.col("seq")).select("id", "entry", "i", (F.col("i") + F.size("seq")).alias("j"))
    parts = entries.select("entry", F.size(words(F.col("term"))).alias("n"), F.posexplode(words(F.col("term"))).alias("k", "tw")).withColumn("key", stem_key(F.col("tw")))
    toks = positions(texts).withColumn("key", stem_key(F.col("w")))
    runs = toks.join(parts, "key").groupBy("id", "entry", (F.col("i") - F.col("k")).alias("i"), "n").agg(F.countDistinct("k").alias("got"))
    return runs.where("got = n and i >= 0").select("id", "entry", "i", (F.col("i") + F.col("n")).alias("j"))


def window_hits(texts: DataFrame, entries: DataFrame, least: int = 3) -> DataFrame:
    """Entries of ``least`` words or more whose words all stand in some window of n + 2 words, in any order: (id, entry).

    Up to BROADCAST_ENTRIES entries (counted) are broadcast: a window begins with one of the entry's words, and is looked at inside the row.
    """
    if entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        terms = entries.select("entry", F.array_distinct(words(F.col("term"))).alias("ws")).where(F.size("ws") >= least)
        terms = terms.select("entry", (F.size("ws") + WINDOW_EXTRA).alias("span"), F.array_distinct(F.transform("ws", lambda w: stem_key(w))).alias("all"))
        terms = terms.select("entry", "span", "all", F.explode("all").alias("key"))
        rows = texts.select("id", F.transform(words(F.col("text")), lambda w: stem_key(w)).alias("keys"))
        met = rows.select("id", "keys", F.posexplode("keys").alias("i", "key")).join(F.broadcast(terms), "key")
        return met.where(F.size(F.array_except("all", F.slice("keys", F.col("i") + 1, F.col("span")))) == 0).select("id", "entry").distinct()
    parts = entries.select("entry", F.size(F.array_distinct(words(F.col("term")))).alias("n"), F.explode(F.array_distinct(words(F.col("term")))).alias("tw"))
    parts = parts.where(F.col("n") >= least).withColumn("key", stem_key(F.col("tw")))
    toks = positions(texts).withColumn("key", stem_key(F.col("w")))
    hits = toks.join(parts, "key").select("id", "entry", "n", "tw", "i")
    starts = hits.select("id", "entry", "n", "tw", F.explode(F.sequence(F.col("i") - F.col("n") - F.lit(WINDOW_EXTRA - 1), F.col("i"))).alias("s"))
    full = starts.groupBy("id", "entry", "n", "s").agg(F.countDistinct("tw").alias("got")).where("got = n")
    return full.select("id", "entry").distinct()


def longest_first(hits: DataFrame, limit: int = HIT_LIMIT) -> DataFrame:
    """Distinct entries of each text, longest first, at most ``limit`` (the feature): (id, entry, rank)."""
    best = hits.groupBy("id", "entry").agg(F.max(F.col("j") - F.col("i")).alias("n"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "entry"))).where(F.col("rank") <= limit)


def by_layer(hits: DataFrame, limit: int = 200) -> DataFrame:
    """Distinct entries of each text by layer, then longest first, at most ``limit`` (a request's size): (id, entry, rank)."""
    best = hits.groupBy("id", "entry", "layer").agg(F.max(F.col("j") - F.col("i")).alias("n"))
    w = Window.partitionBy("id").orderBy("layer", F.desc("n"), "entry")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("id", "entry", "rank")


def nested(hits: DataFrame) -> DataFrame:
    """(id, entry) all of whose places lie inside a longer place of another entry."""
    a, b = hits.alias("a"), hits.alias("b")
    inside = (F.col("a.id") == F.col("b.id")) & (F.col("b.i") <= F.col("a.i")) & (F.col("a.j") <= F.col("b.j")) & (F.col("b.j") - F.col("b.i") > F.col("a.j") - F.col("a.i"))
    free = a.join(b, inside, "left_anti").select("id", "entry")
    return hits.select("id", "entry").distinct().join(free.distinct(), ["id", "entry"], "left_anti")


def missing_targets(hits: DataFrame, entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, entry) found in a text whose target lacks the translation's stems; entries nested in longer ones are not asked.

    ``entries(entry, term, tgt)``, ``targets(id, out)``. A stem is the first max(3, min(5, n - 2)) letters of a word of 4 or more.
    """
    asked = hits.select("id", "entry").distinct().join(nested(hits), ["id", "entry"], "left_anti")
    stems = F.transform(F.filter(words(F.col("tgt")), lambda w: F.length(w) >= 4), lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(3), F.least(F.lit(5), F.length(w) - 2))))
    rows = asked.join(entries.select("entry", stems.alias("stems")), "entry").join(targets, "id")
    return rows.where(~F.forall("stems", lambda s: F.contains(F.lower("out"), s))).select("id", "entry")


def paren_abbreviations(texts: DataFrame, entries: DataFrame, found: DataFrame, limit: int = 6) -> DataFrame:
    """Entries whose term names an abbreviation of the text in parentheses, without those already found."""
    abbr = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}])[A-Z]{2,6}(?![\p{L}\p{N}])"), 0))).alias("a"))
    named = entries.select("entry", F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit(r"\(([A-Z]{2,6})\)"), 1))).alias("a"))
    hits = abbr.join(named, "a").select("id", "entry").distinct().join(found.select("id", "entry").distinct(), ["id", "entry"], "left_anti")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("entry"))).where(F.col("rank") <= limit)


def layered(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two layers: secondary entries whose term (case folded) the primary layer has are dropped."""
    low = F.lower("term")
    own = primary.select(low.alias("t")).distinct()
    rest = secondary.withColumn("t", low).join(own, "t", "left_anti").drop("t")
    return primary.withColumn("layer", F.lit(1)).unionByName(rest.withColumn("layer", F.lit(2)))


def merged_candidates(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """MERGE of (src, tgt, count, author, example) into (src, tgt, count, authors, examples, status), case folded.

    Active pairs add counts, authors and the first three examples; rejected ones stay; pairs of the dictionary are
    skipped; a known source with another target gets a conflict note.
    """
    pair = [F.lower("src").alias("ks"), F.lower("tgt").alias("kt")]
    fresh = new.select("*", *pair).groupBy("ks", "kt").agg(
        F.min("src").alias("n_src"), F.min("tgt").alias("n_tgt"), F.sum("count").alias("n_count"), F.array_sort(F.collect_set("author")).alias("n_authors"), F.array_sort(F.collect_set("example")).alias("n_examples")
    )
    have = known.select(F.lower("src").alias("ks"), F.lower("tgt").alias("kt")).distinct()
    fresh = fresh.join(have, ["ks", "kt"], "left_anti")
    sources = have.select("ks").distinct().withColumn("conflict", F.lit(True))
    both = old.select("*", *pair).join(fresh, ["ks", "kt"], "full_outer").join(sources, "ks", "left")
    active = F.col("status").isNull() | (F.col("status") == "active")
    none = F.array().cast("array<string>")
    return both.select(
        F.coalesce("src", "n_src").alias("src"),
        F.coalesce("tgt", "n_tgt").alias("tgt"),
        (F.coalesce("count", F.lit(0)) + F.when(active, F.coalesce("n_count", F.lit(0))).otherwise(0)).alias("count"),
        F.array_sort(F.when(active, F.array_union(F.coalesce("authors", none), F.coalesce("n_authors", none))).otherwise(F.col("authors"))).alias("authors"),
        F.when(active, F.slice(F.array_distinct(F.concat(F.coalesce("examples", none), F.coalesce("n_examples", none))), 1, 3)).otherwise(F.col("examples")).alias("examples"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full-outer diff by term: added, removed, changed."""
    both = old.select("term", F.col("tgt").alias("old_tgt")).join(new.select("term", F.col("tgt").alias("new_tgt")), "term", "full_outer")
    kind = F.when(F.col("old_tgt").isNull(), "added").when(F.col("new_tgt").isNull(), "removed").when(F.col("old_tgt") != F.col("new_tgt"), "changed")
    return both.withColumn("kind", kind).where("kind is not null")


def versions(events: DataFrame) -> DataFrame:
    """Decision log (key, ts, id, action, tgt) to the latest state of each key and the number of accepted decisions (its version)."""
    o = F.struct("ts", "id")
    accepted = F.col("action") == "accept"
    return events.groupBy("key").agg(
        F.max_by("action", o).alias("state"),
        F.max_by(F.when(accepted, F.col("tgt")), F.when(accepted, o)).alias("tgt"),
        F.sum(F.when(accepted, 1).otherwise(0)).alias("version"),
    )


def searched(entries: DataFrame, query: str, columns: tuple[str, ...], limit: int = 100) -> DataFrame:
    """Parameterised search, case-insensitive, first ``limit`` by term (the page size)."""
    like = F.lit(False)
    for c in columns:
        like = like | F.col(c).ilike(f"%{query}%")
    return entries.where(like).orderBy(F.lower(columns[0]), columns[0]).limit(limit)


def escaped_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def snapshot_lines(entries: DataFrame) -> DataFrame:
    """Markdown rows of a dictionary layer: (section, ord, line)."""
    line = F.concat(F.lit("| "), escaped_cell(F.col("src")), F.lit(" | "), escaped_cell(F.col("tgt")), F.lit(" | "), escaped_cell(F.coalesce("note", F.lit(""))), F.lit(" |"))
    return entries.select("section", F.row_number().over(Window.partitionBy("section").orderBy(F.lower("src"), "src", "tgt")).alias("ord"), line.alias("line"))
