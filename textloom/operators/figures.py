"""Figures: clusters of shapes whose boxes grow as they merge, and the captions that belong to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.cover import uncovered
from textloom.operators.geometry import BLOCK, buckets, grids, linked
from textloom.operators.packed import together
from textloom.sources.scratch import stored

BOX = ["x0", "y0", "x1", "y1"]


def _merged(of: np.ndarray, ids: np.ndarray, box: list[np.ndarray], n: np.ndarray, reach: float) -> tuple:
    """Clusters at the fixpoint of the shapes of many blocks ``of``: those of a block whose last round had no links go into no other."""
    out = []
    while len(of):
        order = np.lexsort((box[1], of))
        of, ids, n, box = of[order], ids[order], n[order], [c[order] for c in box]
        low = linked(*box, reach, of)
        moved = np.zeros(int(of[-1]) + 1, bool)
        moved[of[low != np.arange(len(low))]] = True
        done = ~moved[of]
        out.append((of[done], ids[done], n[done], *(c[done] for c in box)))
        first, at = np.unique(low, return_inverse=True)
        open_ = moved[of[first]]
        low_ids, sums = ids[first], np.bincount(at, n, len(first)).astype(np.int64)
        np.minimum.at(low_ids, at, ids)
        sides = [c[first] for c in box]
        for side, c, f in zip(sides, box, (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
            f.at(side, at, c)
        of, ids, n, box = of[first][open_], low_ids[open_], sums[open_], [c[open_] for c in sides]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (of, ids, n, *box)


def _merged_in_blocks(reach: float):
    """Clusters of each block of whole pages, and whether their page has several blocks; shapes without a box are clusters of their own."""

    def run(keys: pa.Array, found: list[dict]) -> pa.Table:
        whole = np.logical_and.reduce([found[0][c].is_valid().to_numpy(zero_copy_only=False) for c in BOX])
        t, rest = ({c: x[at] if c == "of__" else x.take(pa.array(at)) for c, x in found[0].items()} for at in (np.flatnonzero(whole), np.flatnonzero(~whole)))
        ids, *box = (t[c].to_numpy(zero_copy_only=False) for c in ("id", *BOX))
        block = np.floor(box[1] / BLOCK)
        order = np.lexsort((block, t["of__"]))
        page = t["of__"][order]
        new = np.append(True, (page[1:] != page[:-1]) | (block[order][1:] != block[order][:-1])) if len(order) else np.zeros(0, bool)
        of, page = np.cumsum(new) - 1, page[new]  # the blocks, and the page of each
        of, ids, n, *box = _merged(of, ids[order], [c[order] for c in box], np.ones(len(order), np.int64), reach)
        several = np.bincount(page, minlength=len(keys)) > 1
        columns = {"id": ids, **dict(zip(BOX, box, strict=True))}
        out = pa.table({"page": keys.take(pa.array(page[of])), **columns, "n": n, "several": several[page[of]]})
        one = pa.table({"page": keys.take(pa.array(rest["of__"])), **{c: rest[c] for c in columns}, "n": np.ones(len(rest["of__"]), np.int64), "several": np.zeros(len(rest["of__"]), bool)})
        return pa.concat_tables([out, one])

    return run


def grown(shapes: DataFrame, reach: float) -> DataFrame:
    """Clusters of a page's shapes at the fixpoint: no two clusters' boxes come within ``reach`` of each other: (page, id, box, n).

    Shapes that touch within ``reach`` become one cluster with the box around them, which may touch others in turn; so links are found
    anew in each round between the boxes of the last one, until there are none. The result does not depend on the order: the shapes that
    begin in a block of a page are merged there first, for all pages of a task together, and only clusters of pages with several blocks go
    into the rounds, which are tables of the shared folder; a cluster has the smallest id of its shapes.
    """
    kind, page = shapes.schema["id"].dataType, shapes.schema["page"].dataType.simpleString()
    rows = shapes.select("page", F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in BOX))
    clusters = together([rows], "page", _merged_in_blocks(reach), f"page {page}, id long, x0 double, y0 double, x1 double, y1 double, n long, several boolean")
    clusters = stored(clusters, "figures")
    alone, now = (clusters.where(c).drop("several") for c in ("not several", "several"))
    while True:
        to = stored(grids(now, reach).where("id <> grid"), "links")
        if to.isEmpty():
            return alone.unionByName(now).withColumn("id", F.col("id").cast(kind))
        joined = now.join(to, ["page", "id"], "left").withColumn("id", F.coalesce("grid", "id"))
        now = stored(joined.groupBy("page", "id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n")), "figures")


def figures(shapes: DataFrame, texts: DataFrame, reach: float = 20.0, least: int = 6, width: float = 80.0, height: float = 60.0, captions: int = 2, band: float = 24.0) -> DataFrame:
    """Figures (page, id, box, n, captions): clusters of at least ``least`` shapes and ``width`` by ``height``, with captions and no other text.

    Shapes of which texts cover nine tenths or more are part of the text and left out. A text is a caption if its middle lies within 10 of
    the cluster's box and it is at most 20 wider; any other text that the box cuts makes it no figure. Captions widen the box.
    """
    clusters = grown(uncovered(shapes, texts, 0.9), reach)
    wide = clusters.where((F.col("n") >= least) & (F.col("x1") - F.col("x0") >= width) & (F.col("y1") - F.col("y0") >= height))
    around = buckets(wide.select("page", "id", "n", *(F.col(c).alias(f"f_{c}") for c in BOX), (F.col("y0") - 10).alias("y0"), (F.col("y1") + 10).alias("y1")), band).drop("y0", "y1")
    placed = buckets(texts, band)
    met = around.join(placed.select("page", "band", F.col("id").alias("text_id"), *BOX), ["page", "band"]).where(F.col("band") == F.greatest(F.floor((F.col("f_y0") - 10) / band), F.floor(F.col("y0") / band)))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    own = mx.between(F.col("f_x0") - 10, F.col("f_x1") + 10) & my.between(F.col("f_y0") - 10, F.col("f_y1") + 10) & (F.col("x1") - F.col("x0") <= F.col("f_x1") - F.col("f_x0") + 20)
    cut = (F.col("x0") < F.col("f_x1")) & (F.col("f_x0") < F.col("x1")) & (F.col("y0") < F.col("f_y1")) & (F.col("f_y0") < F.col("y1"))
    sides = [f(F.col(f"f_{c}"), F.coalesce(g(F.when(own, F.col(c))), F.col(f"f_{c}"))).alias(c) for c, f, g in (("x0", F.least, F.min), ("y0", F.least, F.min), ("x1", F.greatest, F.max), ("y1", F.greatest, F.max))]
    told = met.groupBy("page", "id", "n", *(f"f_{c}" for c in BOX)).agg(F.sum(F.when(own, 1).otherwise(0)).alias("captions"), F.sum(F.when(cut & ~own, 1).otherwise(0)).alias("cut"), *sides)
    return told.where((F.col("captions") >= captions) & (F.col("cut") == 0)).select("page", "id", "n", "captions", *BOX)
