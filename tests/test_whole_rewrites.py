"""Rewriting queries over the rows their rules exist for, against brute force."""

import re

import pandas as pd
import pytest

from textloom.plans import catalogue

TEXTS = ["a , b", 'say "x" 3kV &lt;', "on &quot;q&quot; 2024.05.17.", "one  two   three\t four ", "x" + " " * 70 + "y", "", "bizton-\nsagi viz\nIII-\n2 end\nnext", "a\n\nb-\n\nc", "\nplain"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rewrites")
    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": "en", "source": "s"}).to_parquet(d / "documents.parquet")
    return lambda name: catalogue.queries()[name](spark, str(d)).collect()


SEGMENTS = {(k, n): line for k, t in enumerate(TEXTS) for n, line in enumerate(t.split("\n"))}


def test_rewrite_log(rows):
    found = {(r.doc, r.seg): (r.fixed, r.log) for r in rows("rewrite_log")}
    ends = (
        "(см. раздел 5.5) end", "см. разделы 7.2 и 7.3 end", "пуск (см. раздел 4) end", "описано в разделе 8, Разделами 9 end", "на рисунке 5 и из рисунка 12, По рисунку 3 end", "(рисунок 6) и см. рисунок 7 end", "см. раздел 5.2.1 end",
        "текст рисунок 7, см. [3] end", "end",
    )
    tail_of, log = (lambda d, k: f" & 5 мг/кг (см. раздел 4.2), {ends[(d + k) % len(ends)]}"), ["entity", "reference", "unit", "space"]
    assert found.keys() == {k for k, t in SEGMENTS.items() if t}
    assert found[0, 0] == ("a, b" + tail_of(0, 0), log) and found[1, 0] == ('say "x" 3 кВ <' + tail_of(1, 0), log)
    assert found[2, 0] == ("on «q» 2024.05.17." + tail_of(2, 0), ["entity", "reference", "quotes", "unit", "space"])


def test_polish_fixpoint(rows):
    brute = {}
    for k, t in SEGMENTS.items():
        t, n = t.replace(" ", "  "), 0
        for _ in range(3):
            n, t = n + ("  " in t), t.replace("  ", " ")
        brute[k] = (t, n)
    assert {(r.doc, r.seg): (r.fixed, r.passes_done) for r in rows("polish_fixpoint")} == brute


def test_tab_marks(rows):
    def mark(m):
        n = len(m[0])
        return "[TAB]" if n == 1 else f"[TAB×{n}]"

    brute = {k: (re.sub("\t+", mark, t.replace(" ", "\t")), t.replace(" ", "\t")) for k, t in SEGMENTS.items()}
    assert {(r.doc, r.seg): (r.marked, r.back) for r in rows("tab_marks")} == brute


def test_lines_joined(rows):
    brute = {}
    for k, t in enumerate(TEXTS):
        acc = ""
        for x in t.split("\n"):
            if acc == "":
                acc = x
            elif re.search("[a-z]-$", acc) and re.match("[a-z]", x):
                acc = acc[:-1] + x
            elif re.search("[A-Z0-9]-$", acc):
                acc += x
            else:
                acc += " " + x
        brute[k] = acc
    assert {r.doc_id: r.joined for r in rows("lines_joined")} == brute
