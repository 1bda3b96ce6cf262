"""Small tables on which queries once shuffled every word or called Python for every page."""

import os
import random
import re

import pytest

from pyspark.sql import functions as F

from textloom.operators import cover, figures, geometry, ink, packed, tree
from textloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_words_of_hidden_texts_are_not_shuffled(spark, monkeypatch):
    """Texts meet the numbers of their page before they are words, and words stay where they are until they are told."""
    plans = []

    def seen(df, name, real=cover.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(cover, "stored", seen)
    assert catalogue.queries()["hidden_texts"](spark, DATA).count() > 0
    above, _, _ = plans[0].partition("Generate")
    assert "Exchange" not in above and "Join" in above


@pytest.mark.parametrize("at_once", [1, 100, 1 << 18])
def test_shares_of_boxes_meet_as_arrays(spark, monkeypatch, at_once):
    """Boxes and covers of a page meet without a join, whatever pages a task looks at together; equal ids of one size count as one."""
    monkeypatch.setattr(packed, "TOGETHER", at_once)
    rng = random.Random(6)
    spot = lambda w, h: (lambda x, y: (float(x), float(y), float(x + rng.randrange(w)), float(y + rng.randrange(h))))(rng.randrange(-20, 60), rng.randrange(-50, 150))
    boxes = [(p, k % 9, *spot(40, 30)) for p in range(12) for k in range(p)]
    covers = [(p, *spot(30, 80)) for p in range(-1, 14) if p % 5 for _ in range(8)] + [(7, None, 0.0, 1.0, 1.0)]
    at = {}
    for p, k, x0, y0, x1, y1 in boxes:
        at.setdefault((p, k, (x1 - x0) * (y1 - y0)), set()).update((i, j) for q, a, b, c, d in covers if q == p and a is not None for i in range(int(max(a, x0)), int(min(c, x1))) for j in range(int(max(b, y0)), int(min(d, y1))))
    want = sorted((p, k, round(len(spots) / size, 6)) for (p, k, size), spots in at.items() if spots and round(len(spots) / size, 6) >= 0.2)
    a = spark.createDataFrame(boxes, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(covers, "page int, x0 double, y0 double, x1 double, y1 double")
    got = cover.covered_share(a, b, 0.2)
    assert got.dtypes == [("page", "int"), ("id", "int"), ("covered", "double")]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert cover.covered_share(a.where("page > 99"), b).count() == 0 == cover.covered_share(a, b.where("page > 99")).count()


@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_contents_are_gathered_in_one_shuffle(spark, monkeypatch, at_once):
    """Nodes and pieces of a document meet as arrays: cycles, gaps, ties, and pieces without text or place as ever."""
    monkeypatch.setattr(packed, "TOGETHER", at_once)
    rng = random.Random(8)
    nodes = [(d, k * (10**11 if d == 3 else 1), None if k == 0 else (rng.randrange(k) if d % 2 else k - 1) * (10**11 if d == 3 else 1), rng.random() < 0.2) for d in range(9) for k in range(40 * d)]
    nodes += [(20, 0, 1, False), (20, 1, 0, False), (20, 2, 1, False), (20, 3, 3, True), (21, 5, 77, None), (22, 1, None, True)]
    pieces = [(d, rng.choice([None, 0, 1]), rng.randrange(5), k, rng.choice([None, "é", "z", f"w{k}", "日"])) for d, k, _, _ in nodes for _ in range(rng.randrange(4))] + [(2, 0, 0, 999, "no node"), (30, 0, 0, 0, "no document")]
    up = {(d, k): (p, h) for d, k, p, h in nodes}
    want = {}
    for d, page, number, k, text in pieces:
        seen = set()
        while (d, k) in up and k not in seen and not up[d, k][1]:
            seen.add(k)
            k = up[d, k][0]
        if (d, k) in up and k not in seen:
            want.setdefault((d, k), []).append((page is not None, page or 0, number, text is not None, (text or "").encode()))
    want = sorted((d, k, len(x), " ".join(t.decode() for *_, there, t in sorted(x) if there)) for (d, k), x in want.items())
    a = spark.createDataFrame(nodes, "doc int, node long, parent long, h boolean").repartition(3)
    b = spark.createDataFrame(pieces, "doc int, page int, mcid int, node long, text string").repartition(5)
    got = tree.gathered(a, b, F.col("h"))
    assert got.dtypes == [("doc", "int"), ("node", "bigint"), ("n", "bigint"), ("text", "string")]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_printed_words_are_shuffled_once(spark, monkeypatch, at_once):
    """The words of a page go to one place with what each would be: no table is stored, no word is joined; pages and lines without a number count alone."""
    monkeypatch.setattr(packed, "TOGETHER", at_once)
    rng = random.Random(9)
    words = ["abcd", "Név:", "[l", "I", "x", "..", "a1", None, "(]"]
    rows = []
    for page in [None, *range(12)]:
        for k in range(70):
            t, x, y = rng.choice(words), rng.randrange(120), rng.randrange(72)
            odd = lambda v: None if rng.random() < 0.03 else v
            rows.append((page, odd(y // 24), k, 0, t, odd(t), odd(rng.choice([1.0, 6.0, 9.0, 10.0, 11.0, 18.0])), odd(rng.choice([20, 50, 70, 85, 95])), odd(rng.choice([0.04, 0.07, 0.3, 0.6])), odd(rng.random() < 0.6), float(x), odd(float(y)), float(x + rng.choice([9, 20])), float(y + 10)))
    got = ink.printed(spark.createDataFrame(rows, "page int, line int, id int, part int, t string, raw string, h double, conf int, ink double, confirmed boolean, x0 double, y0 double, x1 double, y1 double").repartition(4))
    no = lambda a: None if a is None else not a
    and_ = lambda *a: False if False in a else None if None in a else True
    or_ = lambda *a: no(and_(*map(no, a)))
    less = lambda a, b: None if a is None or b is None else a < b
    fits = lambda p, t: None if t is None else bool(re.search(p, t))
    lines, found = {}, []
    for r in rows:
        if less(r[6], 2) is False:
            lines.setdefault(r[:2], []).append(r[6])
    for page, line, k, part, t, raw, h, conf, pale, sure, x0, y0, x1, y1 in rows:
        if less(h, 2) is not False:
            continue
        heights = sorted(lines[page, line])
        usual, label = heights[(len(heights) - 1) // 2], fits("^[A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű]{3,}:", raw)
        ratio = 0.75 <= (x1 - x0) / (0.1 if y0 is None else max(y1 - y0, 0.1)) <= 1.3
        size = None if raw is None else len(raw)
        box = and_(less(size, 4), less(conf, 60), ratio, or_(h >= 1.15 * usual, fits(r"[\[\]£|]", raw)))
        bullet = and_(and_(less(size, 2), no(less(size, 1))), h < 0.7 * usual, less(0.55, pale))
        light = or_(less(pale, 0.05), and_(less(conf, 80), less(pale, 0.08)), and_(less(conf, 60), len(heights) >= 2 and h > 1.6 * usual))
        hand = and_(or_(light, and_(less(conf, 30), no(sure))), no(label))
        sign = and_(no(hand), fits(r"[^\W_]|[_<>≤≥=±÷+%°Δ×→]", t), no(fits(r"^\[?[LlI1|]{0,2}\]$|^\[$", t)))
        if or_(box, bullet) is False and (hand or sign):
            zone = t is not None and len(re.sub(r"[\W_]", "", t)) >= 2
            doubtful = and_(less(conf, 90), less(pale, 0.08), no(label))
            kind = ("zone" if zone else None) if hand else "asked" if doubtful else "kept"
            found.append((kind, page, k, part, t, x0, y0, x1, y1))
    zones = [f for f in found if f[0] == "zone" and f[6] is not None]
    near = lambda f: f[1] is not None and f[6] is not None and any(z[1] == f[1] and f[5] < z[7] + 3 and f[7] > z[5] - 3 and f[6] < z[8] + 3 and f[8] > z[6] - 3 for z in zones)
    want = [f[1:5] for f in found if f[0] == "kept" or f[0] == "asked" and not near(f)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 100 and any(near(f) for f in found if f[0] == "asked")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Window" not in plan and "Relation" not in plan


def test_pages_of_one_block_stay_out_of_the_rounds(spark, monkeypatch):
    """The shapes of all pages of a task are merged together; only clusters of pages with several blocks go into the rounds, shapes without a box into none."""
    rng = random.Random(10)
    shapes = [(p, k, float(x), float(y), float(x + 20), float(y + 8)) for p in range(60) for k, (x, y) in enumerate((rng.randrange(400), rng.randrange(2390 if p % 6 else 5000)) for _ in range(p))]
    shapes += [(p, 1000, None, 1.0, 2.0, 3.0) for p in (1, 6)]
    seen = []

    def counted(now, reach, real=geometry.grids):
        seen.append({r.page for r in now.select("page").distinct().collect()})
        return real(now, reach)

    monkeypatch.setattr(figures, "grids", counted)
    monkeypatch.setattr(packed, "TOGETHER", 300)
    got = {tuple(r) for r in figures.grown(spark.createDataFrame(shapes, "page int, id int, x0 double, y0 double, x1 double, y1 double").repartition(3), 12.0).collect()}
    want = set()
    for page in range(60):
        now = [[*s[1:], 1] for s in shapes if s[0] == page and s[2] is not None]
        while True:
            pair = next(((a, b) for i, a in enumerate(now) for b in now[:i] if a[1] <= b[3] + 12 and b[1] <= a[3] + 12 and a[2] <= b[4] + 12 and b[2] <= a[4] + 12), None)
            if pair is None:
                break
            a, b = pair
            now = [c for c in now if c is not a and c is not b] + [[min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]]]
        want |= {(page, *c) for c in now}
    assert got == want | {(*s, 1) for s in shapes if s[2] is None}
    assert seen[0] == {p for p in range(60) if len({s[3] // 2400 for s in shapes if s[0] == p and s[2] is not None}) > 1} and len(seen[0]) < 12


@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_shapes_that_texts_cover_go_without_a_join(spark, monkeypatch, at_once):
    monkeypatch.setattr(packed, "TOGETHER", at_once)
    rng = random.Random(11)
    spot = lambda: (lambda x, y: (float(x), float(y), float(x + rng.randrange(1, 20)), float(y + rng.randrange(1, 40))))(rng.randrange(40), rng.randrange(60))
    shapes = [(p, k % 7, *spot()) for p in range(10) for k in range(p * 2)] + [(None, 1, 0.0, 0.0, 5.0, 5.0), (3, 50, None, 0.0, 5.0, 5.0), (4, None, 0.0, 0.0, 5.0, 5.0), (40, 1, 0.0, 0.0, 5.0, 5.0)]
    texts = [(p, *spot()) for p in [*range(2, 13)] for _ in range(5)] + [(None, 0.0, 0.0, 9.0, 9.0), (3, 0.0, None, 9.0, 9.0), (4, 0.0, 0.0, 9.0, 9.0)]
    a = spark.createDataFrame(shapes, "page int, id int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    b = spark.createDataFrame(texts, "page int, x0 double, y0 double, x1 double, y1 double")
    want = a.join(cover.covered_share(a, b, 0.4), ["page", "id"], "left_anti")
    got = cover.uncovered(a, b, 0.4)
    assert got.dtypes == a.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and 20 < got.count() < a.count() - 10
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
