"""Terms of a dictionary: the word sequences that stand for one, and how one is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

#: Words that turn a term into its opposite (fixed values).
NEGATIONS = ("nem",)
#: Service words of notes, which are not shown (fixed values).
SERVICE = r"\[уточнить\]|проверено|(?<![\p{L}\p{N}_])строгий(?![\p{L}\p{N}_])|риск высокий"
CLIP = 110


def term_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), 0)


def abbreviation(w: Column) -> Column:
    letters = F.regexp_replace(w, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")


def without_parentheses(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", " ")


def variants(term: Column, target: Column) -> Column:
    """The word sequences that stand for a term: array of (words, gapped).

    Parentheses explain and are no part of a term, unless nothing else is there. `` / `` separates variants; if the target has a slash
    as well and one word stands before a longer second part, the slash chooses a word, and the first variant takes the rest of the
    second. An ellipsis is a gap: its words are sought in a window. Single short words in small letters are no
    variants, nor is one whose negated twin is there, since it means the opposite.
    """
    core = without_parentheses(term)
    core = F.when(core.rlike(r"[\p{L}\p{N}]"), core).otherwise(F.translate(term, "()", "  "))
    parts = F.transform(F.split(core, r"\s+/\s+"), lambda p: F.struct(term_words(p).alias("words"), p.rlike(r"…|\.\.\.").alias("gap")))
    first, second = parts[0]["words"], F.get(parts, F.lit(1))["words"]
    choice = (F.size(parts) >= 2) & F.contains(without_parentheses(target), F.lit("/")) & (F.size(first) == 1) & (F.size(second) >= 2) & (F.lower(first[0]) != F.lower(second[0]))
    led = F.struct(F.concat(first, F.slice(second, F.lit(2), F.greatest(F.size(second) - 1, F.lit(0)))).alias("words"), F.lit(False).alias("gap"))
    parts = F.when(choice, F.concat(F.array(led), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))).otherwise(parts)
    short = lambda w: (F.size(w) == 1) & (F.length(w[0]) < 3) & ~abbreviation(w[0])
    kept = F.filter(parts, lambda p: (F.size(p["words"]) > 0) & ~short(p["words"]))
    low = F.transform(kept, lambda p: F.lower(F.array_join(p["words"], " ")))
    opposite = lambda p: F.arrays_overlap(low, F.array(*[F.concat(F.lit(f"{n} "), F.lower(F.array_join(p["words"], " "))) for n in NEGATIONS]))
    return F.transform(F.filter(kept, lambda p: ~opposite(p)), lambda p: F.struct(p["words"].alias("words"), (p["gap"] & (F.size(p["words"]) > 1)).alias("gapped")))


def term_line(term: Column, target: Column, note: Column) -> Column:
    """``- term → target  [also: ...; note]``: parentheses of the target and the note without service words go behind, the note clipped."""
    bare = F.trim(F.regexp_replace(target, r"\s*\([^)]*\)", ""))
    also = F.when(bare != "", F.array_join(F.regexp_extract_all(target, F.lit(r"\(([^)]*)\)"), 1), ", ")).otherwise("")
    own = F.regexp_replace(F.regexp_replace(F.coalesce(note, F.lit("")), SERVICE, ""), r"(;\s*){2,}", "; ")
    own = F.left(F.regexp_replace(own, r"^[;\s]+|[;\s]+$", ""), F.lit(CLIP))
    behind = F.array_join(F.filter(F.array(F.when(also != "", F.concat(F.lit("also: "), also)), F.when(own != "", own)), lambda x: x.isNotNull()), "; ")
    return F.concat(F.lit("- "), term, F.lit(" → "), F.when(bare != "", bare).otherwise(target), F.when(behind != "", F.concat(F.lit("  ["), behind, F.lit("]"))).otherwise(""))


def shortened(short: Column, whole: Column, source: Column) -> Column:
    """A shorter form keeps the words of the whole one or abbreviates them with a stop (three letters at least), or is the source itself."""
    bare = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), lambda w: F.lower(F.regexp_replace(w, "^[:;,()«»]+|[:;,()«»]+$", "")))

    def fits(w: Column, have: Column) -> Column:
        stem = F.left(w, F.length(w) - 1)
        return (w == "") | (F.endswith(w, F.lit(".")) & (F.length(w) >= 4) & F.exists(have, lambda x: F.startswith(x, stem)))

    # the words of both are taken once for a row, and only words that the whole form lacks are looked at
    kept = let({"words": bare(short), "have": bare(whole)}, lambda v: F.forall(F.array_except(v["words"], v["have"]), lambda w: fits(w, v["have"])))
    return (F.trim(short) == F.trim(source)) | kept


def shortened_length(scale: Column, whole: Column) -> Column:
    """Letters that a text set at ``scale`` of its size may have: at least 8."""
    return F.greatest(F.lit(8), F.floor(F.length(whole) * F.greatest(F.pow(scale / 0.75, F.lit(2)), F.lit(0.6)))).cast("int")
