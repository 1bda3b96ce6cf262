"""The ways that large inputs take, and whole queries without SQL against plain loops."""

import os

import pytest
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F
from test_rules import brute_realigned

from textloom.operators import dictionary
from textloom.plans import catalogue, rules

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["glossary_hits", "term_context", "glossary_misses"])
def test_large_dictionaries_are_not_broadcast(spark, monkeypatch, name):
    monkeypatch.setattr(dictionary, "BROADCAST_ENTRIES", 0)
    assert spark_rows(catalogue.queries()[name](spark, DATA)) == duck_rows(DATA, catalogue.oracle_sql()[name])


def test_whole_query_of_realigned_answers(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").where("conv_id is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")).collect()
    labels, answers = {}, {}
    for r in rows:
        n = r.turn + 1
        labels.setdefault(r.conv_id, {})[n] = r.t
        moved = n + 1 if r.conv_id % 3 == 0 else n
        answers.setdefault(r.conv_id, {})[moved] = r.t.translate(str.maketrans("aeo", "аео")) if n % 2 == 0 else r.t
    want = set()
    for pic, own in answers.items():
        want |= {(pic, *x) for x in brute_realigned(labels[pic], {n: t.strip(" ") for n, t in own.items()})}
    assert {(x.pic, x.n, x.t, x.from_n) for x in rules.realigned_answers(spark, DATA).collect()} == want and len(want) > 20
