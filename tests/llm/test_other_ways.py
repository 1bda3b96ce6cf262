"""Stages with more ids than are broadcast."""

from textloom.llm import stages


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_without_broadcasts(spark, data, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    steps = [lambda d: stages.uncontaminated(d, benchmark), stages.one_of_each_group]
    with_ = [rows(f(documents)) for f in steps]
    monkeypatch.setattr(stages, "BROADCAST_IDS", 0)
    assert [rows(f(documents)) for f in steps] == with_ and all(0 < len(w) < documents.count() for w in with_)
