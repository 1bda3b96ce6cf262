"""Printed words among recognised ones: handwriting, check boxes, bullets and noise are told by size, ink and confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.geometry import band_pairs
from textloom.operators.packed import together

# Ink of handwriting, and patterns of labels, signs, check boxes and glued labels.
INK_HAND, INK_PALE, INK_SOLID = 0.08, 0.05, 0.55
LABEL = r"^[A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű]{3,}:"
SIGN = r"[\p{L}\p{N}_<>≤≥=±÷+%°Δ×→]"
CHECKBOX = r"^\[?[LlI1|]{0,2}\]$|^\[$"
GLUED = r"^(.+?)([A-ZÁÉÍÓÖŐÚÜŰ][a-záéíóöőúüű]{2,}:)$"
CAPITALS, RULE = r"[A-ZÁÉÍÓÖŐÚÜŰ]{2}", r"^[|Il1\[\]]$"
BRACKETS = r"[\[\]£|]"
# End of the fixed values.

#: What a word may be: handwriting that reaches out, pale and not quite sure, printed; 0 is none of them.
ZONE, ASKED, KEPT = 1, 2, 3


def unglued(words: DataFrame) -> DataFrame:
    """A label that was read as one word with what stands before it becomes a word of its own: adds ``part``; a rule's rest before it goes.

    ``words(page, id, t, x0, x1, ...)``: the box is cut by the share of characters.
    """
    head, label = F.regexp_extract("t", GLUED, 1), F.regexp_extract("t", GLUED, 2)
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * F.length(head) / F.length("t")
    piece = lambda k, t, a, b: F.struct(F.lit(k).alias("part"), t.alias("t"), a.alias("x0"), b.alias("x1"))
    whole = F.array(piece(0, F.col("t"), F.col("x0"), F.col("x1")))
    last = F.array(piece(2, label, cut, F.col("x1")))
    both = F.when(head.rlike(RULE), last).otherwise(F.concat(F.array(piece(1, head, F.col("x0"), cut)), last))
    rest = [c for c in words.columns if c not in ("t", "x0", "x1")]
    out = words.select(*rest, F.explode(F.when(F.contains("t", F.lit(":")) & (label != "") & ~head.rlike(CAPITALS), both).otherwise(whole)).alias("p"))
    return out.select(*rest, "p.part", "p.t", "p.x0", "p.x1")


def _printed(band: float):
    """Of the words of whole pages those that are printed: by ``code`` what each is for what its line tells."""

    def run(keys: pa.Array, found: list[dict]) -> pa.Table:
        t = found[0]
        of, h, code = t["of__"], t["h"].to_numpy(zero_copy_only=False), t["code"].to_numpy(zero_copy_only=False)
        line = t["line"].fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((h, line, of))
        starts = np.flatnonzero(np.append(True, (of[order][1:] != of[order][:-1]) | (line[order][1:] != line[order][:-1]))) if len(order) else order
        n = np.diff(starts, append=len(order))
        usual, several = np.empty(len(h)), np.empty(len(h), bool)
        usual[order], several[order] = np.repeat(h[order][starts + (n - 1) // 2], n), np.repeat(n >= 2, n)
        stays = code >> np.where(h >= 1.15 * usual, 4, np.where(h < 0.7 * usual, 6, 5)) & 1
        kind = np.where(several & (h > 1.6 * usual), code >> 2 & 3, code & 3) * stays
        x0, y0, x1, y1 = (t[c].to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
        told = ~(np.isnan(x0) | np.isnan(y0) | np.isnan(x1) | np.isnan(y1)) & keys.is_valid().to_numpy(zero_copy_only=False)[of]
        asked, zone = np.flatnonzero(told & (kind == ASKED)), np.flatnonzero(told & (kind == ZONE))
        for a, z in band_pairs(of[asked], y0[asked], y1[asked], of[zone], y0[zone] - 3, y1[zone] + 3, band):
            a, z = asked[a], zone[z]
            near = (x0[a] < x1[z] + 3) & (x1[a] > x0[z] - 3) & (y0[a] < y1[z] + 3) & (y1[a] > y0[z] - 3)
            kind[a[near]] = 0
        left = pa.array(np.flatnonzero((kind == KEPT) | (kind == ASKED)))
        return pa.table({"page": keys.take(pa.array(of).take(left)), **{c: t[c].take(left) for c in ("id", "part", "t")}})

    return run


def printed(words: DataFrame, band: float = 24.0) -> DataFrame:
    """The printed words: (page, id, part, t) of ``words(page, line, id, part, t, raw, h, conf, ink, confirmed, x0, y0, x1, y1)``.

    Words under 2 high are no words. Handwriting is very pale, or pale and not sure, or unsure and far higher than its line's lower median, or
    hardly read and not confirmed by the other reader; a field's label never is. Check boxes are unsure, short and nearly square, bullets
    low and solid. Of pale words that are not quite sure, those beside handwriting belong to it. Words without a letter, digit or sign go.
    """
    # what is asked of a word's text is asked once
    asked = {"label": F.col("raw").rlike(LABEL), "framed": F.col("raw").rlike(BRACKETS), "said": F.col("t").rlike(SIGN) & ~F.col("t").rlike(CHECKBOX), "wide": F.length(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]", "")) >= 2}
    told = words.where("h >= 2").withColumns({f"{c}__": x for c, x in asked.items()})
    label = F.col("label__")
    ratio = (F.col("x1") - F.col("x0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(0.1))
    zone = F.when(F.col("wide__"), ZONE)
    doubtful = (F.col("conf") < 90) & (F.col("ink") < INK_HAND) & ~label

    def kind(tall: bool) -> Column:
        pale = (F.col("ink") < INK_PALE) | ((F.col("conf") < 80) & (F.col("ink") < INK_HAND)) | ((F.col("conf") < 60) & F.lit(tall))
        hand = (pale | ((F.col("conf") < 30) & ~F.col("confirmed"))) & ~label
        return F.coalesce(F.when(hand, zone).when(~hand & F.col("said__"), F.when(doubtful, ASKED).otherwise(KEPT)), F.lit(0))

    def stays(high: bool, low: bool) -> Column:
        box = (F.length("raw") <= 3) & (F.col("conf") < 60) & ratio.between(0.75, 1.3) & (F.lit(high) | F.col("framed__"))
        bullet = (F.length("raw") == 1) & F.lit(low) & (F.col("ink") > INK_SOLID)
        return F.coalesce((~box & ~bullet).cast("int"), F.lit(0))

    # what a word is depends on its line's lower median in these ways only: the words of a page are shuffled once, as arrays, with what each would be
    code = kind(False) + 4 * kind(True) + 16 * stays(True, False) + 32 * stays(False, False) + 64 * stays(False, True)
    rows = told.withColumn("code", code.cast("int"))
    unsure = ((F.col("code") % 4).isin(ZONE, ASKED)) | (F.floor(F.col("code") / 4) % 4).isin(ZONE, ASKED)
    box = [F.when(unsure, F.col(c)).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = rows.select("page", F.col("line").cast("long").alias("line"), "id", "part", F.when(F.col("code") % 16 > 0, F.col("t")).alias("t"), F.col("h").cast("double").alias("h"), "code", *box)
    page, id_, part = (words.schema[c].dataType.simpleString() for c in ("page", "id", "part"))
    return together([rows], "page", _printed(band), f"page {page}, id {id_}, part {part}, t string")
