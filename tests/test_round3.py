"""Small tables on which queries once gave other rows than their SQL or broke their limits."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from oracle import duck_rows, spark_rows

from textloom.operators import cover, figures, geometry, ink, memory
from textloom.operators import words as W
from textloom.plans import catalogue


def same(spark, tmp_path, name, **tables):
    for t, rows in tables.items():
        pd.DataFrame(rows).to_parquet(tmp_path / f"{t}.parquet")
    got = spark_rows(catalogue.queries()[name](spark, str(tmp_path)))
    assert got == duck_rows(str(tmp_path), catalogue.oracle_sql()[name])
    return got[1]


@pytest.mark.parametrize("name", ["table_cells_merged", "table_rows_placed"])
def test_cells_of_a_seventh_of_a_page(spark, tmp_path, name):
    """480 / 7 is no whole number: the middle of a cell is at 306.8, behind a vertical at 306."""
    ids = [2033, 2033 + 126]
    html = ["<p>Erorbleon An.</p>" * 7, "".join(f"<p>{'x' * k}</p>" for k in (13, 13, 50, 13, 13, 13, 13))]
    assert same(spark, tmp_path, name, pages={"page_id": ids, "url": ["a"] * len(ids), "html": html})


def test_boxes_are_linked_in_blocks(spark, monkeypatch):
    """Only links between blocks come to the star rounds; groups go over blocks, and rules without a box stay alone."""
    rows = [(1, k, 0.0, 10.0 * k, 5.0, 10.0 * k + 10.0) for k in range(1000)] + [(1, 5000, 90.0, 0.0, 91.0, 9000.0), (1, 5001, 91.0, 7000.0, 95.0, 7001.0), (1, 5002, 300.0, 8.0, 301.0, 9.0), (1, 5003, None, None, None, None)]
    rows += [(2, k, 10.0 * k, 0.0, 10.0 * k + (9.0 if k == 40 else 10.0), 1.0) for k in range(100)]
    seen = []

    def counted(links, real=geometry.components):
        seen.append(links.count())
        return real(links)

    monkeypatch.setattr(geometry, "components", counted)
    got = geometry.grids(spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double"), 0.0)
    assert got.dtypes == [("page", "int"), ("id", "int"), ("grid", "int")]
    want = {(1, k): 0 for k in range(1000)} | {(1, 5000): 5000, (1, 5001): 5000, (1, 5002): 5002, (1, 5003): 5003} | {(2, k): 0 if k <= 40 else 41 for k in range(100)}
    assert {(r.page, r.id): r.grid for r in got.collect()} == want
    assert seen[0] <= 10


def test_verticals_are_not_broadcast(spark):
    """A page's verticals meet its words by a shuffle, once for each block of a page and not for each band."""
    words = spark.createDataFrame([(1, k, "worda", "worda", 0.0, 12.0 * k, 30.0, 12.0 * k + 10.0) for k in range(500)], "page int, id int, t string, raw string, x0 double, y0 double, x1 double, y1 double")
    verticals = spark.createDataFrame([(1, 15.0, -2.0, 4806.0), (1, 12.0, 4801.0, 6000.0)], "page int, x double, y0 double, y1 double")
    got = W.split_at_rules(words, verticals)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") == 1
    cut = {r.id: r.x1 for r in got.where("part = 1").collect()}
    # 4,800 and 4,804 are words' tops: the second vertical takes over where it runs along more than half of a word
    assert cut == {k: 14.0 if k < 400 else 11.0 for k in range(500)}




def test_printed_words_are_worked_out_once(spark):
    """The medians of lines are taken in one stored step; what follows shuffles pale and handwritten words alone."""
    rows = [(1, 0, 0, 0, "abcd", "abcd", 9.0, 95, 0.5, True, 0.0, 0.0, 30.0, 10.0), (1, 0, 1, 0, "hand", "hand", 9.0, 70, 0.06, True, 40.0, 0.0, 60.0, 10.0), (1, 0, 2, 0, "near", "near", 9.0, 85, 0.06, True, 61.0, 0.0, 80.0, 10.0), (1, 0, 3, 0, "far", "far", 9.0, 85, 0.06, True, 90.0, 0.0, 99.0, 10.0)]
    words = spark.createDataFrame(rows, "page int, line int, id int, part int, t string, raw string, h double, conf int, ink double, confirmed boolean, x0 double, y0 double, x1 double, y1 double")
    got = ink.printed(words)
    assert sorted(r.t for r in got.collect()) == ["abcd", "far"]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_runs_are_matched_by_digests(spark):
    """Runs of up to ten long keys meet by 16 bytes each: no text is in the tables that the match joins."""
    long = ["a" * 3000, "b" * 4000, "c" * 5000, "d", "e", "f"]
    ours = spark.createDataFrame([(1, 0, long[0] + long[1]), (1, 1, long[2]), (1, 2, "d"), (1, 3, "e"), (1, 4, "zz")], "doc int, o int, k string")
    theirs = spark.createDataFrame([(1, 0, long[0]), (1, 1, long[1]), (1, 2, long[2]), (1, 3, "de"), (1, 4, "f")], "doc int, o int, k string")
    got = memory.cascaded(ours, theirs, "doc", "o", "k")
    assert {r.place: r.how for r in got.collect()} == {1: "joined", 2: "exact", 3: "part", 4: "part", 5: "own"}
    types = memory.consecutive(ours, "doc", "o", "k").dtypes
    assert types == [("doc", "int"), ("place", "int"), ("digests", "array<binary>")]


def test_hidden_texts_are_told_by_one_stored_join(spark):
    """Texts meet an array of pictures by block, without a grouping of the texts; what follows reads the stored rows."""
    items = [(1, k, k, "text", False, 480.0 * 6000, 0.0, 12.0 * k, 10.0, 12.0 * k + 10) for k in range(500)] + [(1, -1, 300, "image", True, 480.0 * 6000, -1.0, -1.0, 600.0, 6010.0)]
    got = cover.hidden_text(spark.createDataFrame(items, "page int, id int, ord int, kind string, opaque boolean, page_area double, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(r.id for r in got.collect()) == list(range(300))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_shapes_of_a_block_are_merged_before_the_rounds(spark, monkeypatch):
    shapes = [(1, k, 10.0 * (k % 20), 5.0 * k, 10.0 * (k % 20) + 9, 5.0 * k + 4) for k in range(400)] + [(1, 900, 0.0, 5000.0, 1.0, 5001.0), (2, 1, 0.0, 2390.0, 5.0, 2399.0), (2, 2, 0.0, 2401.0, 5.0, 2409.0)]
    seen = []

    def counted(now, reach, real=geometry.grids):
        seen.append(now.count())
        return real(now, reach)

    monkeypatch.setattr(figures, "grids", counted)
    got = figures.grown(spark.createDataFrame(shapes, "page int, id int, x0 double, y0 double, x1 double, y1 double"), 12.0)
    assert sorted((r.page, r.id, r.n) for r in got.collect()) == [(1, 0, 400), (1, 900, 1), (2, 1, 2)]
    assert seen[0] == 4


def test_groups_of_thousands_in_rows(spark, tmp_path):
    """Numbers of four groups and more, and marks that come about when groups are joined, as in the SQL."""
    texts = ["1 234 567 890 and 1,234,567,890,123", "<f1,234> 12 345 678 901\n555 123 456 789 012", "10,000,00 <f1 234>"]
    n = [k for k in range(35) for _ in texts]
    got = same(spark, tmp_path, "issue_rows_ru_en", documents={"doc_id": range(105), "text": texts * 35, "lang": ["ru"] * 105, "source": [f"{k}" for k in n]})
    assert len(got) > 100


def quickly(df, most):
    from time import monotonic

    began = monotonic()
    got = df.collect()
    assert monotonic() - began < most
    return got


def test_shortenings_of_long_lines(spark, tmp_path):
    """The words of both forms are taken once for a row, not once for each word."""
    from textloom.functions import terms as T

    line = " ".join(f"w{k}" for k in range(6000))
    rows = spark.createDataFrame([(line, line), (line + " w99. zz.", line), ("w1. W2, «w3» wxy.", line), ("abc.", "abcdef")], "s string, t string")
    found = rows.select(T.shortened(F.col("s"), F.col("t"), F.lit("\x00")).alias("ok"))
    assert [r.ok for r in quickly(found, 8)] == [True, False, False, True]
    pd.DataFrame({"doc_id": [0, 1, 2, 3], "text": [line, "a b. c", "Ab; ab, «Ab» x", ""], "lang": "x", "source": "y"}).to_parquet(tmp_path / "documents.parquet")
    same(spark, tmp_path, "shortenings")


def test_long_answers_are_read_once(spark):
    """Objects of an answer are read once each, and the last one of a number counts."""
    from textloom.functions import answers as A

    one = lambda n, t: '{"n": %d, "t": "%s", "lang": "x"}' % (n, t)
    answer = "Here: [" + ", ".join([one(k, f"t{k}" + (' "q" ' if k % 4 == 3 else "")) for k in range(1200)] + [one(7, "again"), '{"n": "8", "t": "torn']) + "]"
    got = quickly(spark.createDataFrame([(answer,)], "a string").select(F.explode(A.answer_objects(F.col("a"))).alias("o")).select("o.*"), 8)
    assert len(got) == 1200 and {r.n: r.t for r in got} == {k: f"t{k}" + (' "q" ' if k % 4 == 3 else "") for k in range(1200)} | {7: "again"}


def test_marks_of_single_tabs(spark):
    """Lines without runs of tabs go without their pieces; runs, marks that are there already and breaks come out as ever."""
    from textloom.functions import text as X

    want = {"a\tb\nc": "a[TAB]b[BR]c", "\t\ta\n\n\nb\t": "[TAB×2]a[BR×3]b[TAB]", "[TAB×3]\tx": "[TAB×3][TAB]x", "": "", "\t": "[TAB]", "[B\tR]": "[B[TAB]R]"}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", X.runs_marked(F.col("t")).alias("m")).withColumn("back", X.runs_expanded("m"))
    assert {r.t: r.m for r in rows.collect()} == want
    assert {r.t: r.back for r in rows.collect()} == {t: t.replace("[TAB×3]", "\t\t\t") for t in want}
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "contains(t" in plan.lower() and "[(?:TAB|BR)[×x]" in plan


@pytest.mark.parametrize("block", [65_536, 8])
def test_chains_are_linked_in_blocks(spark, monkeypatch, block):
    """One stored table where chains stay in their block; else only the nodes that chains enter are doubled."""
    from textloom.operators import tree

    stores = []

    def counted(df, name, real=tree.stored):
        stores.append(name)
        return real(df, name)

    monkeypatch.setattr(tree, "stored", counted)
    rows = [(1, k, k - 1 if k else None, k == 5) for k in range(300)] + [(2, k, k // 2 if k else None, k % 11 == 3) for k in range(200)]
    rows += [(3, 0, 20, False), (3, 20, 40, False), (3, 40, 0, False), (3, 41, 40, None), (3, 7, 99, False), (3, 8, 8, True), (3, 9, 8, False), (4, 70, 1, True)]
    up = {(d, k): (p, h) for d, k, p, h in rows}

    def holder(d, k):
        seen = set()
        while (d, k) in up and k not in seen:
            if up[d, k][1]:
                return k
            seen.add(k)
            k = up[d, k][0]
        return None

    nodes = spark.createDataFrame(rows, "doc long, node int, parent int, h boolean")
    if block != 65_536:
        monkeypatch.setattr(tree, "BLOCK", block)
    got = tree.holders(nodes, F.col("h"))
    assert got.dtypes == [("doc", "bigint"), ("node", "int"), ("holder", "int")]
    assert {(r.doc, r.node): r.holder for r in got.collect()} == {(d, k): holder(d, k) for d, k, _, _ in rows}
    if block == 65_536:
        assert stores == ["holders"]


def test_windows_are_looked_at_in_the_row(spark):
    """A small dictionary makes no rows of windows: only found entries are shuffled."""
    from textloom.operators import dictionary

    entries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two"), (3, "delta deltoid omega"), (4, "beta beta alpha gamma")], "entry int, term string")
    texts = spark.createDataFrame([(1, "gamma x alphas y beta"), (2, "gamma x x alpha y beta"), (3, "omega delta"), (4, None), (5, "one two one"), (6, "Beta, gammas; x z ALPHA b")], "id int, text string")
    got = dictionary.window_hits(texts, entries)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 4), (3, 3), (6, 1), (6, 4)]
    assert "count(distinct" not in got._jdf.queryExecution().analyzed().toString()


def test_short_rows_are_aligned_together(monkeypatch):
    """Rows of equal numbers of words and pieces go through the cells together, with the groups of plain loops."""
    import random

    r = random.Random(3)
    lengths = [[r.randint(0, 9) for _ in range(r.choice([1, 2, 7, 8, 8, 8, 20]))] for _ in range(600)]
    widths = [[w for x in row for w in r.choice([[x * 5.5 + r.randint(1, 3)], [x * 3.0 + 1, x * 2.5], []])] for row in lengths]
    widths[5] = []
    want = [W.aligned(a, b) for a, b in zip(lengths, widths, strict=True)]
    monkeypatch.delattr(W, "_in_loops")
    assert W.many_aligned(lengths, widths) == want


def test_codes_of_long_pairs(spark):
    """The text in which codes are looked for is made once for a pair, not once for each code."""
    from textloom.functions import text as X

    src, out = " ".join(f"K{k}-a Word" for k in range(6000)), " ".join(f"K{k} слово–слово" for k in range(1, 6000))
    found = spark.createDataFrame([(src, out), ("5bar 30TL02S001 x", "5 бар")], "s string, t string").select(X.codes_missing(F.col("s"), F.col("t")).alias("m"))
    # K0 is no part of a longer code in the target
    assert [r.m for r in quickly(found, 8)] == [["K0"], ["30TL02S001"]]
