"""Language pairs, leaders, sinks and sources: known answers and plain loops."""

import os
import random
import re

from pyspark.sql import functions as F

from textloom.functions import languages as L
from textloom.operators import align
from textloom.plans import catalogue, rules
from textloom.plans import reading as Q
from textloom.sources import sinks

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_clean(t):
    def rep(m):
        s = m[0]
        noisy = re.search(L.TRIPLE, s) or re.match(L.LEADER_START, s)
        return "…" if noisy and sum(c in L.LEADER_NOISE for c in s) / len(s) >= 0.8 else s

    return re.sub(L.LEADER.replace(r"\p{L}\p{N}_", r"\w"), rep, t)


def test_leaders(spark):
    clean = lambda c: L.without_leaders(F.col(c))
    rng = random.Random(1)
    texts = ["Tartalom......eeessszz 12", "szükségessége: képzés", "sssszzzzeeeégí x", "A.....iiiii", ""] + ["".join(rng.choice("szeégí.,:…itn01 xA") for _ in range(rng.randrange(5, 60))) for _ in range(800)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean("t").alias("o")).collect()
    assert [r.o for r in got] == [plain_clean(r.t) for r in got] and sum("…" in r.o and "…" not in r.t for r in got) > 1
    rows = {(r.doc, r.seg): r.clean for r in Q.leaders_removed(spark, DATA).collect()}
    whole = {(r.doc, r.seg): r.text + Q._NOISE[(r.doc + r.seg) % len(Q._NOISE)] for r in Q.seg(spark, DATA).collect()}
    assert rows == {k: plain_clean(t) for k, t in whole.items()}


def test_pairs_of_languages(spark):
    df = spark.createDataFrame([("ru-en",), (" Hu - RU ",), ("",), (None,), ("ru-ru",), ("de-en",), ("x",)], "p string")
    got = [r.p for r in df.select(L.parsed_pair(F.col("p")).alias("p")).collect()]
    assert [tuple(x) if x else None for x in got] == [("ru", "en"), ("hu", "ru"), ("hu", "ru"), ("hu", "ru"), None, None, None]
    words = spark.createDataFrame([("ноутбук НСБ (BLÜGY)", "BLÜGY laptop"), ("пара PARAMÉTERNÉV", "x"), ("Paksi Atomerőmű érték", "x")], "o string, s string")
    assert [r.w for r in words.select(L.source_words(F.col("s"), F.col("o")).alias("w")).collect()] == [[], ["PARAMÉTERNÉV"], ["érték"]]


def test_states_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "states")
    sinks.overwrite_documents(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc int, t string"), path)
    sinks.overwrite_documents(spark.createDataFrame([(1, "z")], "doc int, t string"), path)
    assert {(r.doc, r.t) for r in spark.read.parquet(path).collect()} == {(1, "z"), (2, "c")}
    sinks.replace_table(spark.createDataFrame([(9, "q")], "doc int, t string"), path + "2")
    sinks.replace_table(spark.createDataFrame([(8, "r")], "doc int, t string"), path + "2")
    assert [tuple(r) for r in spark.read.parquet(path + "2").collect()] == [(8, "r")]


def test_every_check_fires(spark):
    """Each code of the pair checks and conventions occurs in the queries' rows, and good pairs have none."""
    for name, codes in (
        ("issue_rows_hu_ru", "marks breaks missing_codes extra_numbers source_left foreign_script mixed_alphabet untranslated length negation_lost action_flip empty"),
        ("issue_rows_ru_en", "marks breaks missing_codes extra_numbers latin_lost source_left foreign_script untranslated length empty"),
    ):
        found = {re.split("[: ]", r.issue)[0] for r in catalogue.queries()[name](spark, DATA).select("issue").distinct().collect()}
        assert found >= set(codes.split()), (name, set(codes.split()) - found)
    flips = {r.issue for r in rules.issue_rows_hu_ru(spark, DATA).where("issue like 'action_flip%'").select("issue").distinct().collect()}
    assert flips == {f"action_flip {name}" for name in ("open/close", "on/off", "start/stop", "load/unload")}
    found = {r.rule.split(":")[0] for r in rules.convention_breaks(spark, DATA).select("rule").distinct().collect()}
    assert found == {"name", "abbreviation", "warning", "term", "code"}


def plain_merged(first, second):
    """Two readings, from the aligner's steps: who is believed where."""
    from difflib import SequenceMatcher

    normal = lambda ws: ["".join(c for c in w.lower() if c.isalnum()) for w in ws]
    a, b = normal(first), normal(second)
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op in ("equal", "replace") and j - i == m - k:
            for x, y, p, q in zip(first[i:j], second[k:m], a[i:j], b[k:m], strict=True):
                out.append(y if not p or not q or align.coded(x) or align.coded(y) else x)
        elif op == "replace":
            out += [" ".join(second[k:m])] if any(align.coded(w) for w in first[i:j] + second[k:m]) else first[i:j]
        elif op == "delete":
            out += [w for w, p in zip(first[i:j], a[i:j], strict=True) if p]
        elif op == "insert" and i > 0:
            if out and first[i - 1 : i]:
                out[-1] = f"{out[-1]} {' '.join(second[k:m])}" if out[-1] else " ".join(second[k:m])
    return out


def test_whole_query_of_merged_readings(spark):
    rows = rules.seg(spark, DATA).select("doc", "seg", "text").collect()
    want = {}
    for r in rows:
        second = [w for w in r.text.replace("O", "0").replace(".", ",").split(" ") if len(w) != 2]
        want[r.doc, r.seg] = " ".join(plain_merged(r.text.split(" "), second))
    got = {(r.doc, r.seg): r.merged for r in rules.merged_readings(spark, DATA).collect()}
    assert got == want and sum(want[r.doc, r.seg] != r.text for r in rows) > 100
