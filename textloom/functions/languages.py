"""Language pairs, what is done for each of them, and words that stayed in the source's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import rewrite as R

# Languages, the pair without a name, words of table headers, noise of dotted leaders.
LANGUAGES, DEFAULT = ("hu", "ru", "en"), ("hu", "ru")
HEADER = {"венгерский": "hu", "magyar": "hu", "hungarian": "hu", "русский": "ru", "orosz": "ru", "russian": "ru", "английский": "en", "angol": "en", "english": "en"}
LEADER = r"[.,…:;]+[szeégí.,:;…itn0-9]{8,}|(?<![\p{L}\p{N}_À-ɏ])[szeégí][szeégí.,:;…itn]{9,}"
TRIPLE, LEADER_START, LEADER_NOISE = r"([a-zé])\1\1", r"^[.,…:;]{3,}", "szeégí.,:;…0123456789"
# End of the fixed values.


def parsed_pair(c: Column) -> Column:
    """Struct (src, tgt) of a pair like ``ru-en``; an empty one is the default, any other text gives null."""
    form = r"^\s*([a-z]{2})\s*-\s*([a-z]{2})\s*$"
    src, tgt = (F.regexp_extract(F.lower(c), form, k) for k in (1, 2))
    fine = src.isin(*LANGUAGES) & tgt.isin(*LANGUAGES) & (src != tgt)
    default = F.struct(F.lit(DEFAULT[0]).alias("src"), F.lit(DEFAULT[1]).alias("tgt"))
    return F.when(c.isNull() | (c == ""), default).when(fine, F.struct(src.alias("src"), tgt.alias("tgt")))


def file_suffix(c: Column) -> Column:
    return F.concat(F.lit("_"), F.upper(parsed_pair(c)["tgt"]))


def header_languages(first: Column, second: Column) -> Column:
    """Struct (src, tgt) of a table header's first two cells; null if they name no two languages."""
    names = F.create_map(*[F.lit(x) for pair in HEADER.items() for x in pair])
    a, b = (F.try_element_at(names, F.lower(F.trim(c))) for c in (first, second))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.struct(a.alias("src"), b.alias("tgt")))


def finished(pair: Column, src: Column, out: Column) -> Column:
    """A target's last steps by its pair: capitals and units for hu-ru, units for other pairs into Russian, else none."""
    p = parsed_pair(pair)
    return F.when((p["src"] == "hu") & (p["tgt"] == "ru"), R.units(R.capitals_lowered(src, out))).when(p["tgt"] == "ru", R.units(out)).otherwise(out)


def without_leaders(c: Column) -> Column:
    """Dotted leaders that were read as letters become one ellipsis: runs with a letter three times or dots at the start, four fifths of it noise."""
    runs = F.regexp_extract_all(c, F.lit(LEADER), 0)
    between = F.split(c, LEADER, -1)
    noisy = lambda x: (x.rlike(TRIPLE) | x.rlike(LEADER_START)) & ((F.length(x) - F.length(F.translate(x, LEADER_NOISE, ""))) / F.length(x) >= 0.8)
    shown = F.transform(runs, lambda x: F.when(noisy(x), "…").otherwise(x))
    return F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def source_words(src: Column, out: Column) -> Column:
    """Hungarian words of a target: all small, all capitals or joined by a low line; not an abbreviation in brackets that the source has."""
    words = F.regexp_extract_all(out, F.lit("[A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű_]{2,}"), 0)
    kind = lambda w: w.rlike("[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]") & ((F.lower(w) == w) | (F.upper(w) == w) | F.contains(w, F.lit("_")))
    first_use = lambda w: (F.upper(w) == w) & F.contains(out, F.concat(F.lit("("), w, F.lit(")"))) & F.contains(src, w)
    return F.filter(words, lambda w: kind(w) & ~first_use(w))
