"""What covers what: text under pictures, and shares of boxes that other boxes cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.geometry import PAIRS, _ranges, _rounded, band_pairs
from textloom.operators.packed import together
from textloom.sources.scratch import stored

BOX = ["x0", "y0", "x1", "y1"]


def hidden_text(items: DataFrame, big: float = 0.5, most: float = 0.7) -> DataFrame:
    """Text that is not seen: (page, id, x0, y0, x1, y1).

    ``items(page, id, ord, kind, opaque, page_area, x0, y0, x1, y1)`` are drawn in the order of ``ord``; ``kind`` is text, unseen (a layer
    of text that is never painted) or image. A text is hidden if an opaque image of ``big`` of the page or more, drawn after it, holds it
    whole. A page of which more than ``most`` of the texts would be hidden has a watermark: there only the unseen ones are.
    """
    box = ["x0", "y0", "x1", "y1"]
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    images = items.where((F.col("kind") == "image") & F.col("opaque") & (area >= big * F.col("page_area")))
    last = images.groupBy("page", *box).agg(F.max("ord").alias("later")).groupBy("page").agg(F.collect_list(F.struct(*box, "later")).alias("over"))
    holds = lambda i: (i["x0"] <= F.col("x0")) & (i["y0"] <= F.col("y0")) & (i["x1"] >= F.col("x1")) & (i["y1"] >= F.col("y1")) & (i["later"] > F.col("ord"))
    # items that are dealt by page already are not shuffled; what is shown leaves only its page to be counted by
    drawn = items.where(F.col("kind").isin("text", "unseen")).join(last.hint("shuffle_hash"), "page", "left")
    under = F.when(F.col("kind") == "text", F.coalesce(F.exists("over", holds), F.lit(False)))
    told = drawn.select("page", "id", *box, under.alias("under"))
    marked = stored(told.select("page", "under", *(F.when(F.coalesce("under", F.lit(True)), F.col(c)).alias(c) for c in ("id", *box))), "hidden")
    pages = marked.where("under is not null").groupBy("page").agg((F.sum(F.when(F.col("under"), 1).otherwise(0)) <= most * F.count("*")).alias("fine"))
    hidden = marked.where("under").join(pages.where("fine").hint("shuffle_hash"), "page", "left_semi")
    return hidden.unionByName(marked.where("under is null")).select("page", "id", *box)


def union_area(rects: Column) -> Column:
    """Area of the union of boxes, structs (x0, y0, x1, y1): in each strip between neighbouring x the covered y are added up once."""
    xs = F.array_sort(F.array_distinct(F.flatten(F.transform(rects, lambda r: F.array(r["x0"], r["x1"])))))
    zero = F.struct(F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("sum"))

    def covered(left: Column, right: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(rects, lambda r: (r["x0"] <= left) & (r["x1"] >= right)), lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))))
        add = lambda acc, s: F.struct(F.greatest(acc["end"], s["y1"]).alias("end"), (acc["sum"] + F.greatest(s["y1"] - F.greatest(F.coalesce(acc["end"], s["y0"]), s["y0"]), F.lit(0.0))).alias("sum"))
        return F.aggregate(spans, zero, add, lambda acc: acc["sum"] * (right - left))

    strips = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1))), lambda k: F.coalesce(covered(F.get(xs, k - 1), F.get(xs, k)), F.lit(0.0)))
    return F.aggregate(strips, F.lit(0.0), lambda a, x: a + x)


def _union_areas(of: np.ndarray, n: int, x0, y0, x1, y1) -> np.ndarray:
    """Areas of the unions of the boxes of each of ``n`` owners ``of``, as ``union_area`` has them; boxes stand in the order of their owners."""
    out = np.zeros(n)
    count = np.bincount(of, minlength=n)
    starts, most = np.append(0, np.cumsum(count)), np.cumsum(2 * count * count)
    at = 0
    while at < n:  # runs of owners with about PAIRS boxes in all their strips
        stop = max(at + 1, int(np.searchsorted(most, (most[at - 1] if at else 0) + PAIRS, side="right")))
        a, z = starts[at], starts[stop]
        if a < z:
            owner = of[a:z] - at
            side, whose = np.concatenate([x0[a:z], x1[a:z]]), np.concatenate([owner, owner])
            order = np.lexsort((side, whose))
            side, whose = side[order], whose[order]
            new = np.append(True, (side[1:] != side[:-1]) | (whose[1:] != whose[:-1]))
            side, whose = side[new], whose[new]
            strip = np.flatnonzero(whose[1:] == whose[:-1])
            left, right, whose = side[strip], side[strip + 1], whose[strip]
            each = count[at:stop][whose]
            s, r = np.repeat(np.arange(len(strip)), each), a + np.repeat(starts[at:stop][whose] - a, each) + _ranges(each)
            inside = (x0[r] <= left[s]) & (x1[r] >= right[s])
            s, r = s[inside], r[inside]
            order = np.lexsort((y1[r], y0[r], s))
            s, r = s[order], r[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            by_rank = np.argsort(rank, kind="stable")
            end, high = np.full(len(strip), -np.inf), np.zeros(len(strip))
            for some in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]) if len(s) else []:  # the first of every strip, the second of every strip, ...
                k, low, top = s[some], y0[r[some]], y1[r[some]]
                high[k] += np.maximum(top - np.maximum(end[k], low), 0)
                end[k] = np.maximum(end[k], top)
            out[at:stop] = np.bincount(whose, high * (right - left), stop - at)
        at = stop
    return out


def _covered(a: dict, b: dict, share: float, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of boxes of ``a`` (the first of those with equal part, id and size) of which the boxes of ``b`` take at least ``share``, and the shares."""
    none = np.zeros(0, np.int64), np.zeros(0)
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ([t[c].to_numpy(zero_copy_only=False) for c in BOX] for t in (a, b))
    if not len(ax0) or not len(bx0):
        return none
    size = (ax1 - ax0) * (ay1 - ay0)
    ids = a["id"].to_numpy(zero_copy_only=False)
    order = np.lexsort((size, ids, a["of__"]))
    same = np.append(False, (np.diff(a["of__"][order]) == 0) & (ids[order][1:] == ids[order][:-1]) & (np.diff(size[order]) == 0))
    first = order[~same]
    owner = np.empty(len(order), np.int64)
    owner[order] = np.cumsum(~same) - 1
    found = []
    for x, y in band_pairs(a["of__"], ay0, ay1, b["of__"], by0, by1, band):
        clipped = np.maximum(ax0[x], bx0[y]), np.maximum(ay0[x], by0[y]), np.minimum(ax1[x], bx1[y]), np.minimum(ay1[x], by1[y])
        met = (clipped[0] < clipped[2]) & (clipped[1] < clipped[3])
        found.append((owner[x[met]], *(c[met] for c in clipped)))
    if not any(len(f[0]) for f in found):
        return none
    of, *box = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    area = _union_areas(of[order], len(first), *(c[order] for c in box))
    some = np.unique(of)
    covered = _rounded(area[some] / size[first[some]])
    return first[some][covered >= share], covered[covered >= share]


def _meeting(boxes: DataFrame, covers: DataFrame) -> list[DataFrame]:
    whole = F.col("page").isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    sides = [F.col(c).cast("double").alias(c) for c in BOX]
    return [boxes.where(whole).select("page", "id", *sides), covers.where(whole).select("page", *sides)]


def covered_share(boxes: DataFrame, covers: DataFrame, share: float = 0.5, band: float = 24.0) -> DataFrame:
    """Boxes of which ``covers`` take at least ``share``; what several covers take counts once: (page, id, covered).

    Boxes and covers are shuffled once, as arrays, and the pages of a task meet there together, by bands.
    """

    def run(keys: pa.Array, found: list[dict]) -> pa.Table:
        at, covered = _covered(*found, share, band)
        return pa.table({"page": keys.take(pa.array(found[0]["of__"][at])), "id": found[0]["id"].take(pa.array(at)), "covered": covered})

    page, id_ = (boxes.schema[c].dataType.simpleString() for c in ("page", "id"))
    return together(_meeting(boxes, covers), "page", run, f"page {page}, id {id_}, covered double")


def uncovered(boxes: DataFrame, covers: DataFrame, share: float = 0.5, band: float = 24.0) -> DataFrame:
    """The boxes (page, id, box) that ``covered_share`` does not name."""

    def run(keys: pa.Array, found: list[dict]) -> pa.Table:
        a, b = found
        there = keys.is_valid().to_numpy(zero_copy_only=False)
        whole = [there[t["of__"]] & np.logical_and.reduce([t[c].is_valid().to_numpy(zero_copy_only=False) for c in BOX]) for t in found]
        places = [np.flatnonzero(w) for w in whole]
        at, _ = _covered(*({c: x[p] if c == "of__" else x.take(pa.array(p)) for c, x in t.items()} for t, p in zip(found, places, strict=True)), share, band)
        at = places[0][at]
        # all boxes of a page with the id of one that is named
        order = np.lexsort((a["id"].fill_null(-1).to_numpy(zero_copy_only=False), a["of__"]))
        ids, of = a["id"].fill_null(-1).to_numpy(zero_copy_only=False)[order], a["of__"][order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])) if len(order) else np.zeros(0, bool)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        named = np.zeros(int(new.sum()), bool)
        named[group[at]] = True
        left = pa.array(np.flatnonzero(~named[group] | a["id"].is_null().to_numpy(zero_copy_only=False)))
        return pa.table({"page": keys.take(pa.array(a["of__"]).take(left)), **{c: a[c].take(left) for c in ("id", *BOX)}})

    page, id_ = (boxes.schema[c].dataType.simpleString() for c in ("page", "id"))
    sides = [F.col(c).cast("double").alias(c) for c in BOX]
    return together([boxes.select("page", "id", *sides), covers.select("page", *sides)], "page", run, f"page {page}, id {id_}, " + ", ".join(f"{c} double" for c in BOX))


def page_kinds(items: DataFrame) -> DataFrame:
    """(page, scan): a scan is a page of which images take half or more; ``items`` as in hidden_text."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    images = F.sum(F.when(F.col("kind") == "image", area).otherwise(0.0))
    return items.groupBy("page").agg((images >= 0.5 * F.max("page_area")).alias("scan"))


def suits_segments(pages: DataFrame) -> DataFrame:
    """(doc, pages, ocr, scans, suits): half of a document's pages or more are recognised, and under half of those are scans; pages(doc, page, scan, ocr)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = pages.groupBy("doc").agg(F.count("*").alias("pages"), count(F.col("ocr")).alias("ocr"), count(F.col("ocr") & F.col("scan")).alias("scans"))
    return out.withColumn("suits", (F.col("ocr") > 0) & (2 * F.col("ocr") >= F.col("pages")) & (2 * F.col("scans") < F.col("ocr")))
