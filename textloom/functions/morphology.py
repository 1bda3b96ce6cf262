"""Stems and negation morphemes as regular expressions over whole words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of Russian words (fixed values).
RU_ENDINGS = """а я о е ы и у ю ь й ом ем ой ей ою ею ам ям ах ях ами ями ов ев ий ия ие ии ию ией ием иям иях
иями ья ье ью ьи ьей ьям ьях ьями ая яя ое ее ую юю ые ый ого его ому ему ым им ых их ыми ими""".split()

#: Pieces of Hungarian suffix chains (fixed values).
HU_SUFFIXES = """nak nek ban ben ból ből ról ről tól től hoz hez höz val vel nál nél ért ként kor ig ba be ra re
on en ön n t at et ot öt ök ok ek ak k i ai ei a e á é ja je já jé uk ük unk ünk juk jük ság ség ú ű s os es ös as ul ül
vá vé ának ének jának jének ait eit jait jeit stul""".split()

#: Suffixes that term mining drops (fixed values).
MINED_SUFFIXES = """jának jének ának ének ainak einek jával jével ával ével ból ből ról ről tól től hoz hez höz
ban ben nak nek val vel nál nél ra re ba be on en ön at et ot öt ok ek ak ai ei ja je t""".split()

#: Negating suffixes, further tails after them, words in which they do not negate, words that negate (fixed values).
NEGATIVE = "hatatlan hetetlen talan telen atlan etlen otlan tlan tlen".split()
NEGATIVE_TAILS = "ság ség ul ül ná né ok ek ségé ságá sága sége".split()
NOT_NEGATIVE = "hirtelen kedvezőtlen haladéktalan maradéktalan közvetlen független".split()
NEGATING_WORDS = "nem sem nincs nincsenek ne tilos".split()
#: Beginnings of Russian words that negate, and of such that only look so (fixed values).
RU_NEGATIVE = "не без бес обез обес ни де(?=[агмзсф]) отсутств нет утеч теч[ьи] разгерм запрещ наруш".split()
RU_NOT_NEGATIVE = "необходим немедлен нескольк некотор нередк неделя недел немн неон".split()


def _any(parts: list[str]) -> str:
    return "|".join(sorted(parts, key=lambda p: (-len(p), p)))


#: Longest pieces first; a tail of at most three.
CHAIN = f"(?:{_any(HU_SUFFIXES)}){{0,3}}"
_NEGATED = f"^.{{3,}}(?:{_any(NEGATIVE)})(?:{_any(NEGATIVE_TAILS)})?{CHAIN}$"


def is_suffix_chain(tail: Column) -> Column:
    return tail.rlike(f"^{CHAIN}$")


def ru_stem(word: Column) -> Column:
    """Without the longest ending that leaves three letters."""
    low = F.translate(F.lower(word), "ё", "е")
    return F.regexp_replace(low, f"^(.{{3,}}?)(?:{_any(RU_ENDINGS)})$", "$1")


def stem(word: Column) -> Column:
    """Russian words by their endings; others of five letters or more without a final a or e."""
    low = F.lower(word)
    other = F.when(F.length(low) >= 5, F.regexp_replace(low, "[ae]$", "")).otherwise(low)
    return F.when(low.rlike("^[а-яё]"), ru_stem(word)).otherwise(other)


def mined_stem(word: Column) -> Column:
    """Two times the longest mined suffix off, as long as four letters stay."""
    for _ in range(2):
        word = F.regexp_replace(word, f"^(.{{4,}}?)(?:{_any(MINED_SUFFIXES)})$", "$1")
    return word


def matches_word(term: Column, word: Column) -> Column:
    """A word of a text is the term's stem and an ending (Russian) or a chain of suffixes; words with digits match whole."""
    s, low = stem(term), F.lower(word)
    tail = F.substr(low, F.length(s) + 1)
    ru = F.startswith(low, s) & ((tail == "") | tail.isin(*RU_ENDINGS))
    hu = F.startswith(low, s) & is_suffix_chain(tail)
    return F.when(term.rlike("^[0-9]") | (F.length(s) < 3), low == F.lower(term)).when(s.rlike("^[а-яё]"), ru).otherwise(hu)


def negated_words(text: Column) -> Column:
    """Words of six letters or more with a negating morpheme."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsLatin}{6,}"), 0)
    off = "^(?:" + "|".join(NOT_NEGATIVE) + ")"
    return F.filter(words, lambda w: ~w.rlike(off) & (w.rlike(_NEGATED) | w.rlike("^(?:inhermetikus|instabil)")))


def negations(text: Column) -> Column:
    """Negated words and negating words of a Hungarian text."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsLatin}+"), 0)
    return F.size(negated_words(text)) + F.size(F.filter(tokens, lambda w: w.isin(*NEGATING_WORDS)))


def ru_negations(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), r"(?<![а-яё])(?:" + "|".join(RU_NOT_NEGATIVE) + ")", " ")
    return F.size(F.regexp_extract_all(clean, F.lit(r"(?<![а-яё])(?:" + "|".join(RU_NEGATIVE) + ")"), 0))


def negation_lost(src: Column, out: Column) -> Column:
    """Fewer negations in the target than in the source."""
    return (negations(src) > 0) & (ru_negations(out) < negations(src))
