"""Syllables of Russian words, soft hyphens, and how wide a text is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of hyphenation by P. Khristov, in order; a mark goes between what the first and the second stand for.
_X, _V, _C, _ANY = "[йьъ]", "[аеёиоуыэюя]", "[бвгджзклмнпрстфхцчшщ]", "[а-яё]"
RULES = [(_X, _ANY + _ANY), (_V, _V + _ANY), (_C + _V, _C + _V), (_V + _C, _C + _V), (_C + _V, _C + _C + _V), (_V + _C + _C, _C + _C + _V)]
#: Words that are hyphenated, and widths of Helvetica's characters in thousandths of the size.
LONG_WORD = "[А-Яа-яЁё]{6,}"
HELVETICA = {
    191: "'", 222: "ijl", 260: "|¦", 278: " !,./:;I[\\]ft·ÌÍÎÏìíîï", 333: "()-`r¡­¨¯²³´¸¹", 334: "{}", 355: '"', 365: "º", 370: "ª", 389: "*", 400: "°", 469: "^", 500: "Jckxyzsvçýÿ",
    537: "¶", 556: "#$0123456789?L_abdeghnopqu¢£¤¥§«µ»àáâãäåèéêëðñòóôõöùúûüþ", 584: "+<=>~¬±×÷", 611: "FTZ¿ßø", 667: "&ABEKPSVXYÀÁÂÃÄÅÈÉÊËÝÞ", 722: "CDHNRUwÇÐÑÙÚÛÜ", 737: "©®",
    778: "GOQÒÓÔÕÖØ", 833: "Mm", 834: "¼½¾", 889: "%æ", 944: "W", 1000: "Æ", 1015: "@",
}
#: Width of every other character, and of a capital where capitals count as wider.
OTHER, CAPITAL = 600, 720
# End of the fixed values.
_RULES = [(re.compile(f"({a})({b})"), "\\1\n\\2") for a, b in RULES]
_KINDS = {ord(c): kind[1] for kind in (_X, _V, _C) for small in kind[1:-1] for c in (small, small.upper())}
_WORDS, _MIXED = re.compile(f"({LONG_WORD})"), re.compile("[а-яё][А-ЯЁ]")


#: Words, and kinds of words, whose parts a task remembers; beyond, it begins anew.
REMEMBERED = 1 << 18


@lru_cache(REMEMBERED)
def _cuts(kinds: str) -> tuple[int, ...]:
    """Where words part whose letters are of these kinds (й, а or б for each); the rules ask for no more."""
    low = kinds
    for _ in range(2):
        for rule, by in _RULES:
            low = rule.sub(by, low)
    low = re.sub(r"^(.)\n", r"\1", low)
    low = re.sub(r"\n(.)$", r"\1", low)
    ends = [m.start() for m in re.finditer("\n", low)]
    return tuple(e - k for k, e in enumerate(ends))


def parted(word: str) -> str:
    """The word with a line feed at every place where it may part. Letters go by what they stand for, capitals as small ones."""
    cuts = _cuts(word.translate(_KINDS))
    return "\n".join(word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)), strict=True)) if cuts else word


def _hyphenated(text: str, mark: str, small: bool, known: dict[str, tuple[str, bool, bool]]) -> str:
    out = _WORDS.split(text)
    for k in range(1, len(out), 2):
        word = out[k]
        told = known.get(word)
        if told is None:
            if len(known) >= REMEMBERED:
                known.clear()
            told = known[word] = parted(word), word.upper() == word, _MIXED.search(word) is not None
        parts, capitals, mixed = told
        if not (mixed or capitals and small):
            out[k] = parts.replace("\n", mark)
    return "".join(out)


def hyphenated(text: Column, mark: Column, context: Column | None = None) -> Column:
    """The text with ``mark`` at every place where a long Russian word may part; abbreviations, told by the context, stay whole.

    Abbreviations have capitals only within a context that has small letters, or a capital behind a small letter. Texts repeat their words, so
    each task parts a word once: the rules, which go over a word twice, are too many for every occurrence.
    """
    small = (text if context is None else context).rlike("[а-яё]")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, tuple[str, bool, bool]] = {}
        for texts, marks, smalls in batches:
            yield pd.Series([None if t is None or m is None or s is None else _hyphenated(t, m, bool(s), known) for t, m, s in zip(texts, marks, smalls, strict=True)], dtype=object)

    return run(text, mark, small)


def pieces(word: Column, context: Column) -> Column:
    """A word's pieces between the places where it may part, with their hyphens."""
    return F.split(hyphenated(word, F.lit("-­"), context), "­", -1)


def width(text: Column, size: Column, capitals: bool = False) -> Column:
    """Width in points: each character of Helvetica by its own, every other one by an average."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    total = sum((count(chars) * w for w, chars in HELVETICA.items()), F.lit(0))
    known = "".join(HELVETICA.values())
    rest = F.translate(text, known, "")
    low = F.regexp_replace(rest, r"\p{Lu}", "")
    wide = F.length(low) * OTHER + (F.length(rest) - F.length(low)) * (CAPITAL if capitals else OTHER)
    return F.round((total + wide) * size / 1000, 3)
