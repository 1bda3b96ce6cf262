"""Hard negatives by a full sort of each anchor's scores.

Rows are vectors with a label. An anchor's scores are its integer inner products with all rows; higher ones come first, equal ones by
smaller id. Its positives are its first rows of the same label; for each positive, its negatives are the first rows of another label whose
scores lie between a share of the positive's score and that score.

Rows and anchors are dealt into blocks by a hash of a stored row number, and every block of anchors meets every block of rows once: a stated
query set against all rows, in blocks. A task holds one block of each (ROW_BLOCK and ANCHOR_BLOCK rows) and, anchor by anchor, sorts all
scores of the block with lexsort. The first pass keeps the first rows of the same label, the second searches each positive's
upper limit by bisection and reads the first rows of another label down to the lower limit. Blocks' results are merged by a ranked window, of
which Spark keeps only the first rows before it shuffles. So no task holds an anchor's whole list, however many rows there are, and
labels play no part in the dealing.

Scores are exact: components are integers in doubles, and products run in doubles as long as no sum can pass 2^53, beyond that in Python's
integers; a score outside a long's range (of either sign) counts as the largest long of its sign.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a null id can be no
anchor and comes last among equal scores. Vectors of different length are compared as if the shorter one ended in zeros. A repeated row is a
row: it is an anchor, a positive or a negative as often as it occurs. Other columns are not read and may have any name.
An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import prepare, stored

POSITIVES, NEGATIVES = 5, 5
#: Of a negative's score, in hundredths of the positive's: at least and at most.
LOW, HIGH = 80, 100
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
LAST = int(np.iinfo(np.int64).max)


def components(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component, as doubles, a row for each vector; shorter vectors are filled with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.floor(256 * flat)
    lengths = np.asarray(vectors.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def scores_of(anchor: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products of an anchor with all rows; ``largest`` is the largest size of a row's component."""
    width = min(len(anchor), rows.shape[1])
    a, r = anchor[:width], rows[:, :width]
    if math.fsum(np.abs(a)) * largest < 2.0**53:
        return (r @ a).astype(np.int64)
    a = [int(x) for x in a]
    return np.array([max(-LAST, min(LAST, sum(x * int(y) for x, y in zip(a, row, strict=True)))) for row in r], dtype=np.int64)


def _block(table: pa.Table) -> dict:
    """A block of rows: ids with nulls last, labels, components."""
    t = table.combine_chunks()
    ids = t.column("id")
    vectors = t.column("vector").combine_chunks()
    vectors = vectors if isinstance(vectors, pa.Array) else vectors.chunk(0)
    q = components(vectors)
    return {
        "n": t.num_rows, "rid": t.column("rid").to_numpy(), "id": ids.fill_null(LAST).to_numpy(), "null": ids.is_null().to_numpy(zero_copy_only=False),
        "label": t.column("label").to_numpy(), "q": q, "largest": float(np.abs(q).max(initial=0)),
    }


def _sorted(rows: dict, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = scores_of(anchor, rows["q"], rows["largest"])
    order = np.lexsort((rows["id"], rows["null"], -scores))
    return order, scores[order]


def _first_positives(k: int):
    """The first k other rows of an anchor's label in a block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            r, a = _block(rows), _block(anchors)
            for j in range(a["n"]):
                order, scores = _sorted(r, a["q"][j])
                found = np.flatnonzero((r["label"][order] == a["label"][j]) & (r["rid"][order] != a["rid"][j]))[:k]
                for s in found:
                    x = order[s]
                    out["anchor"].append(int(a["rid"][j]))
                    out["id"].append(None if r["null"][x] else int(r["id"][x]))
                    out["score"].append(int(scores[s]))
        return pa.table({"anchor": pa.array(out["anchor"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def _first_negatives(k: int, low: int, high: int):
    """For each positive of an anchor, the first k rows of another label within the limits in a block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "positive": [], "id": [], "score": []}
        if rows.num_rows and anchors.num_rows:
            r, a = _block(rows), _block(anchors)
            wanted = anchors.column("positives").to_pylist()
            for j in range(a["n"]):
                order, scores = _sorted(r, a["q"][j])
                others = np.flatnonzero(r["label"][order] != a["label"][j])
                rising = -scores[others]
                for p in wanted[j]:
                    # 100 * negative <= high * positive: from the largest whole score on that is low enough
                    top, floor = (high * p["score"]) // 100, -((-low * p["score"]) // 100)
                    start = int(np.searchsorted(rising, -top))
                    for s in others[start : start + k]:
                        if scores[s] < floor:
                            break
                        x = order[s]
                        out["anchor"].append(int(a["rid"][j]))
                        out["positive"].append(p["no"])
                        out["id"].append(None if r["null"][x] else int(r["id"][x]))
                        out["score"].append(int(scores[s]))
        kinds = {"anchor": pa.int64(), "positive": pa.int32(), "id": pa.int64(), "score": pa.int64()}
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    return run


def taking_part(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector) of the rows with a label and a whole finite vector."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return x.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def hard_negatives(
    rows: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows(id, label, vector)``; ``anchors`` is the condition for an anchor."""
    spark = rows.sparkSession
    prepare(spark)
    kept = stored(rows.select("id", "label", "vector", F.monotonically_increasing_id().alias("rid"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")), "vectors")
    n, n_anchors = kept.agg(F.count("*"), F.count(F.when(F.col("is_anchor"), 1))).first()
    blocks, anchor_blocks = max(1, -(-n // row_block)), max(1, -(-n_anchors // anchor_block))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("rid"), F.lit(k)).cast("int")
    all_rows = kept.select("rid", "id", "label", "vector", dealt(blocks).alias("rb"), every(anchor_blocks).alias("ab")).groupBy("ab", "rb")
    own = kept.where("is_anchor")

    def met(side: DataFrame, run, schema: str) -> DataFrame:
        dealt_side = side.withColumns({"ab": dealt(anchor_blocks)}).withColumn("rb", every(blocks))
        return all_rows.cogroup(dealt_side.groupBy("ab", "rb")).applyInArrow(run, schema)

    def first(df: DataFrame, by: list[str], k: int) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return df.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k)

    near = first(met(own.select("rid", "id", "label", "vector"), _first_positives(positives), "anchor long, id long, score long"), ["anchor"], positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("no", "id", "score"))).alias("positives"))
    known = stored(own.select("rid", "id", "label", "vector").join(near, F.col("rid") == F.col("anchor")).drop("anchor"), "anchors")
    hard = first(met(known, _first_negatives(negatives, low, high), "anchor long, positive int, id long, score long"), ["anchor", "positive"], negatives)
    named = known.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p"))
    named = named.select("anchor", "anchor_id", F.col("p.no").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = hard.join(named, ["anchor", "positive"])
    return out.select("anchor_id", "positive_id", F.col("no").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the table: labels of ids divisible by 7 move on by one, anchors have ids divisible by 100."""
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(taking_part(embeddings).withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE = """
with v as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label :: bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x :: double)) as q from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select a.r as a, a.vec_id as anchor_id, a.label = b.label as same, b.r as b, b.vec_id as id, list_inner_product(a.q, b.q) :: bigint as score
    from v as a join v as b on a.r <> b.r or a.label <> b.label where a.vec_id % 100 = 0
),
p as (select * from (select *, row_number() over (partition by a order by score desc, id) as no from s where same) where no <= 5),
n as (
    select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.a, p.no order by s.score desc, s.id) as rank
    from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
)
select anchor_id, positive_id, rank :: int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
