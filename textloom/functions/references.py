"""References to sections and figures of a Russian text in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

# Results have to follow these forms letter by letter.
#: Forms of the word for a chapter, and of the word for a section that stands for each.
CHAPTER_FORMS = {
    "глава": "раздел", "главы": "раздела", "главе": "разделе", "главу": "раздел", "главой": "разделом", "главах": "разделах", "главам": "разделам", "главами": "разделами",
}
#: The case of the word for a figure by the preposition before it.
FIGURE_FORMS = {"на": "рисунке", "в": "рисунке", "к": "рисунку", "по": "рисунку", "с": "рисунком", "под": "рисунком", "из": "рисунка", "до": "рисунка"}
NUMBER = r"\d+(?:\.\d+)*"
CYRILLIC = "А-Яа-яЁё"
SECTIONS = rf"([Сс]м)\.:?\s*({NUMBER})(\s*(?:и|,)\s*)({NUMBER})(?!\s*\])"
SECTION = rf"([Сс]м)\.:?\s*({NUMBER})(?![\d\]])"
COLON = r"([Сс]м)\.:\s*(раздел|рисун|\[)"
IN_BRACKETS = rf"\((?:[Гг]лава|[Рр]аздел)\s+({NUMBER})\)"
POINT = rf"([Сс]м)\.\s*п\.\s*({NUMBER}\.\d+)"
#: One form of a figure after 'see', which loses its colon, and one in brackets.
SEE_FIGURE = r"([Сс]м\.):?(\s*)рис\.\s*(\d+)"
FIGURE_IN_BRACKETS = r"\(рис\.\s*(\d+)"
CAPITAL_FIGURE = rf"(?<=[{CYRILLIC},;:)»\p{{L}}\p{{N}}_]\s)Рисун(ок|ке|ка|ку|ком)(\s+\d+)"
# End of the fixed values.


def _forms() -> list[tuple[str, str, str]]:
    """What is exchanged for what, in order, and what a text has to hold for that; a word that has forms gives a pair for each, small and with a capital.

    What has to be there is never made by a form before, so it is looked for in the text as it comes.
    """
    out = [("м.", SECTIONS, "$1. разделы $2$3$4"), ("м.", SECTION, "$1. раздел $2"), ("м.:", COLON, "$1. $2"), ("(", IN_BRACKETS, "(см. раздел $1)")]
    for old, new in CHAPTER_FORMS.items():
        out += [("лав", rf"(?<![{CYRILLIC}]){f(old)}(?=\s+{NUMBER})", f(new)) for f in (str, str.capitalize)]
    out.append(("п.", POINT, "$1. раздел $2"))
    for preposition, figure in FIGURE_FORMS.items():
        out += [("рис.", rf"(?<![{CYRILLIC}]){f(preposition)}\s+рис\.\s*(\d+)", f"{f(preposition)} {figure} $1") for f in (str, str.capitalize)]
    return [*out, ("рис.", SEE_FIGURE, "$1$2рисунок $3"), ("(рис.", FIGURE_IN_BRACKETS, "(рисунок $1"), ("Рисун", CAPITAL_FIGURE, "рисун$1$2")]


def exchanged(text: Column, forms: list[tuple[str, str, str]]) -> Column:
    """The text after all forms (held, pattern, replacement) in order; only those are tried whose ``held`` is in the text."""
    table = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("held", "form", "by"), f, strict=True)]) for f in forms])
    return let({"text": text}, lambda v: F.aggregate(F.filter(table, lambda f: F.contains(v["text"], f["held"])), v["text"], lambda acc, f: F.regexp_replace(acc, f["form"], f["by"])))


def references(c: Column) -> Column:
    """Pairs of sections, sections, chapters by case, points, and figures by the preposition before them or after 'see'.

    A text without a number keeps what it is, so it goes through none of the forms.
    """
    return F.when(c.rlike(r"\d"), exchanged(c, _forms())).otherwise(c)
