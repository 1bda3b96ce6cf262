"""Operators as filters of whole rows: what the corpus pipeline is made of.

Every function keeps all columns of its input, whatever they are called, and drops rows only. Rows are judged where they
are, so texts are shuffled only where more ids go than BROADCAST_IDS.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import decontaminate, langid, pieces, quality, simhash
from textloom.llm.common import crc_mod, prepare, stored
from textloom.operators.graph import components

#: Ids to drop, up to this number, are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A language must be at least this sure.
LEAST_SCORE = 0.5


def rows_kept(docs: DataFrame, judge) -> DataFrame:
    """Rows whose text ``judge(texts) -> list of bool`` keeps; ``judge`` is made once in each task by a call without argument."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        decide = judge()
        for b in batches:
            yield b.filter(pa.array(decide(b.column(at).to_pylist()), pa.bool_()))

    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    plain = docs.toDF(*[f.name for f in fields])  # by position: a name with a dot cannot be resolved in a map
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*docs.columns)


def left_out(docs: DataFrame, gone: DataFrame, met) -> DataFrame:
    """Rows of ``docs`` (as ``d``) that meet no row of ``gone`` (as ``g``); names may be the same on both sides."""
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = gone.alias("g")
    return docs.alias("d").join(F.broadcast(gone) if small else gone, met, "left_anti")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text hash are not in ``gone(doc_id, text_hash)``."""
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("g.text_hash"))
    return left_out(docs, gone.select("doc_id", "text_hash").distinct(), same)


def good_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Rows that the quality classifier scores at its threshold or above."""
    import numpy as np

    stats = stored(quality.document_statistics(docs), "quality")
    model = quality.fit(stats.where(crc_mod("doc_id", folds) != held), labels)

    def judge():
        def decide(texts):
            if not texts:
                return []
            return (model.score(np.array([quality.statistics(t) for t in texts])) >= quality.THRESHOLD).tolist()

        return decide

    return rows_kept(docs, judge)


def known_language(docs: DataFrame, folds: int = 3, held: int = 1, least: float = LEAST_SCORE) -> DataFrame:
    """Rows in a learned language: not ``und``, and with a score of ``least`` or more. Without learned languages, all rows."""
    model = langid.fit(docs.where(crc_mod("doc_id", folds) != held))
    if not model.names:
        return docs

    def judge():
        letters = langid.Letters()

        def decide(texts):
            names, scores = model.predict(langid.profiles(texts, letters))
            return [n != langid.UNKNOWN and s >= least for n, s in zip(names, scores.tolist(), strict=True)]

        return decide

    return rows_kept(docs, judge)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id."""
    found = stored(simhash.near_duplicates(docs), "groups")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    if not repeated:
        # doc_id names a row; a lone null is its own component's name or goes with its group.
        gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
        return left_out(docs, gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")))
    # Repeated ids: a row is named by doc_id and fingerprint. A component's name may be the doc_id of rows with several of its
    # fingerprints; the one of the smallest fingerprint stays, and of equal rows one.
    roots = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp").distinct()
    links = components(simhash.near_links(roots.select("fp").distinct()))
    kept = roots.join(links, roots.fp == links.node, "left").groupBy("doc_id", F.coalesce("root", "fp").alias("root")).agg(F.min("fp").alias("fp"))
    rows = stored(with_fingerprint(docs), "rows-fp")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.fp") == F.col("g.fp"))
    one = rows.alias("d").join(kept.alias("g"), same, "left_semi").dropDuplicates(["doc_id", "fp"])
    return one.select(*[F.col(f"c{k}") for k in range(len(docs.columns))]).toDF(*docs.columns)


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, c0, c1, ...): the fingerprint and all columns, by position, so that no name of theirs is in the way."""
    import numpy as np

    prepare(docs.sparkSession)
    fields = [docs.schema["doc_id"], T.StructField("fp", T.LongType()), *[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]]
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        for b in batches:
            fps = np.array([simhash.fingerprint(x.as_py()) for x in b.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(at), pa.array(fps.view(np.int64)), *b.columns], [f.name for f in fields])

    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(run, T.StructType(fields))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that hold less of the benchmark than the contamination rule allows."""
    found = stored(decontaminate.contamination(docs, benchmark).where("contaminated").select("doc_id", "text_hash"), "contaminated")
    return without(docs, found)


def tokenized(docs: DataFrame) -> DataFrame:
    return pieces.digests(docs)
