"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are lower-cased in A-Z and taken as runs outside ASCII punctuation, space and controls. Of every ``SPAN - GRAM + 1``
consecutive hashes of GRAM words the least is kept with its place; so any span of SPAN words that a document shares with
an item contains a fingerprint that both keep. Document and benchmark fingerprints are joined by hash, a hit is extended to
all windows of SPAN words around its place, and these are joined with the items' windows by their words, so
a hash collision never makes a hit. An item of fewer words is one window; for each such length that occurs (at most
SPAN - 1) all places of a document are its fingerprints.

A benchmark of up to BROADCAST_WINDOWS windows is broadcast (its size is counted first) and documents are never
shuffled, only hits and one row for each document are; a larger one is joined by shuffles of fingerprints, and only documents
with a common fingerprint meet their words again.

Defined results: null texts have no words; repeated rows get a row each, with equal results; a null item_id makes
hits but is in no list of items; an empty benchmark hits nothing. Positions hold up to 2^31 words of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 13, 6
BROADCAST_WINDOWS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(_WORD), 0), F.array().cast("array<string>"))


def _ahead(a: str, k: int) -> Column:
    return F.slice(a, F.lit(k + 1), F.size(a))


def _with_grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns g1, g2, g4, g8 as far as needed: hashes of so many words from each place on."""
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    k = 1
    while 2 * k <= max(lengths):
        df = df.withColumn(f"g{2 * k}", F.zip_with(f"g{k}", _ahead(f"g{k}", k), lambda a, b: F.xxhash64(a, b)))
        k *= 2
    return df


def _packed(length: int) -> Column:
    """For each place: 32 bits of the hash of ``length`` words from there on, then 31 bits of the place."""
    powers = [1 << b for b in range(4, -1, -1) if length >> b & 1]
    first, at, rest = powers[0], powers[0], []
    for p in powers[1:]:
        rest.append((p, at))
        at += p

    def pack(h: Column, i: Column) -> Column:
        whole = F.xxhash64(h, *[F.get(f"g{p}", i + o) for p, o in rest], F.lit(length))
        return F.shiftleft(whole.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(i.cast("long"))

    return F.transform(f"g{first}", pack)


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``kept``: packed fingerprints, winnowed for SPAN and complete for the short lengths."""
    out = _with_grams(df, [GRAM, *short]).withColumn("m1", _packed(GRAM))
    width, k = SPAN - GRAM + 1, 1
    while k < width:
        step = min(k, width - k)
        out = out.withColumn(f"m{k + step}", F.zip_with(f"m{k}", _ahead(f"m{k}", step), lambda a, b: F.least(a, b)))
        k += step
    return out.withColumn("kept", F.concat(F.array_distinct(f"m{width}"), *[_packed(m) for m in short]))


def _hash(f: str) -> Column:
    return F.shiftright(F.col(f), 31)


def _place(f: str) -> Column:
    return F.col(f).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _windows(words_: str, lengths: Column) -> Column:
    """Structs (s, len, w) of the windows of ``lengths`` words."""
    n = F.size(words_)
    starts = F.when(n >= lengths, F.sequence(F.lit(0), n - lengths)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), lengths.alias("len"), F.array_join(F.slice(words_, s + 1, lengths), " ").alias("w")))


#: Fingerprint -1 stands for the text itself. It also keeps Spark from inferring a filter on the array of fingerprints, which it
#: would push below all the steps that make it and so repeat them.
_OWN_AND_KEPT = "concat(array(-1L), kept)"


class Benchmark:
    """Windows (w, items) and fingerprints (fp, len) of the items."""

    def __init__(self, benchmark: DataFrame):
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
        items = items.withColumn("len", F.least(F.size("words"), F.lit(SPAN)))
        self.short = sorted(r[0] for r in items.where(F.col("len") < SPAN).select("len").distinct().collect())
        spread = items.select("item", F.explode(_windows("words", F.col("len"))).alias("x"))
        self.windows = spread.groupBy(F.col("x.w").alias("w")).agg(F.collect_set("item").alias("items"))
        kept = fingerprints(items, self.short).select(F.explode(F.expr(_OWN_AND_KEPT)).alias("f")).where("f >= 0")
        # A fingerprint of a short item is looked for at its place alone; both kinds differ by the length in the hash.
        self.prints = kept.select(_hash("f").alias("fp")).distinct()
        self.small = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= BROADCAST_WINDOWS

    def hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _candidate_windows(short: list[int]) -> Column:
    """Windows (s, len) that may hold the fingerprint at ``place``: SPAN words around it, short ones from it on."""
    low = F.greatest(F.col("place") - (SPAN - GRAM), F.lit(0))
    high = F.least(F.col("place"), F.col("n") - SPAN)
    around = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    spans = F.transform(around, lambda s: F.struct(s.alias("s"), F.lit(SPAN).alias("len")))
    from_it = [F.struct(F.col("place").alias("s"), F.lit(m).alias("len")) for m in short]
    return F.filter(F.concat(spans, F.array(*from_it)) if short else spans, lambda x: x["s"] + x["len"] <= F.col("n"))


def _covered(hits: Column) -> Column:
    """Words within the union of the windows, sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def add(acc: Column, x: Column) -> Column:
        end = x["s"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(end - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("sum"))

    return F.aggregate(hits, zero, add, lambda acc: acc["sum"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items, contaminated) for every row; items are ids as strings, sorted."""
    bench = Benchmark(benchmark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    prints = fingerprints(texts, bench.short).select("doc_id", "h", "words", "n", "kept")
    if bench.small:
        # -1 passes both joins.
        spread = prints.select("doc_id", "h", "words", "n", F.explode(F.expr(_OWN_AND_KEPT)).alias("f"))
        met = spread.withColumn("fp", _hash("f")).join(bench.hint(bench.prints.withColumn("met", F.lit(True))), "fp", "left")
        met = met.where("f = -1 or met").withColumn("place", _place("f"))
        none = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).alias("len")))
        rows = met.select("doc_id", "h", "words", "n", F.explode(F.when(F.col("f") == -1, none).otherwise(_candidate_windows(bench.short))).alias("x"))
        rows = rows.select("doc_id", "h", "n", "x", F.array_join(F.slice("words", F.col("x.s") + F.when(F.col("x.s") < 0, 2).otherwise(1), F.col("x.len")), " ").alias("w"))
        hits = rows.join(bench.hint(bench.windows), "w", "left").where("x.s < 0 or items is not null")
    else:
        own = texts.select("doc_id", "h", "n", F.struct(F.lit(-1).alias("s"), F.lit(0).alias("len")).alias("x"), F.lit(None).cast("array<string>").alias("items"))
        met = prints.select("doc_id", "h", "n", F.explode(F.expr(_OWN_AND_KEPT)).alias("f")).where("f >= 0").withColumn("fp", _hash("f")).join(bench.prints, "fp").withColumn("place", _place("f"))
        spots = met.select("doc_id", "h", F.explode(_candidate_windows(bench.short)).alias("x")).distinct()
        again = texts.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "words", "n").dropDuplicates(["d", "g"])
        rows = spots.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
        rows = rows.select("doc_id", "h", "n", "x", F.array_join(F.slice("words", F.col("x.s") + 1, F.col("x.len")), " ").alias("w"))
        hits = own.unionByName(rows.join(bench.windows, "w").select("doc_id", "h", "n", "x", "items"))
    found = F.col("x.s") >= 0
    summed = hits.groupBy("doc_id", "h").agg(
        F.max("n").alias("n"),
        F.sum(F.when(found, 0).otherwise(1)).cast("int").alias("copies"),
        F.collect_set(F.when(found, F.col("x"))).alias("hits"),
        F.collect_set(F.when(found, F.col("items"))).alias("items"),
    )
    told = summed.select(
        "doc_id",
        F.col("h").alias("text_hash"),
        F.col("n").cast("long").alias("n_words"),
        _covered(F.array_sort("hits")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")
    return told.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
ORACLE = rf"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as words from documents),
b as (select item_id, {_SQL_WORDS} as words from benchmark),
win as (
    select distinct item_id, m, array_to_string(words[i : i + m - 1], ' ') as w
    from (select item_id, words, least(13, len(words)) as m, unnest(range(1, len(words) - least(13, len(words)) + 2)) as i from b where len(words) > 0)
),
spot as (
    select r, m, i, array_to_string(words[i : i + m - 1], ' ') as w
    from (select r, words, m, unnest(range(1, len(words) - m + 2)) as i from d, (select distinct m from win) where len(words) >= m)
),
hit as (select r, spot.m as m, i, item_id from spot join win using (w)),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from (select distinct r, i, m from hit)) group by r),
items as (
    select r, count(distinct item_id) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
    from (select distinct r, item_id from hit) group by r
)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join cover using (r) left join items using (r)
"""
