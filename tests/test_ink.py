"""Filters of recognised words against plain loops."""

import random
import re

from textloom.operators import ink


def plain_unglued(t, x0, x1):
    m = re.match(ink.GLUED, t)
    if not m or re.search(ink.CAPITALS, m[1]):
        return [(0, t, x0, x1)]
    cut = x0 + (x1 - x0) * len(m[1]) / len(t)
    return ([] if re.match(ink.RULE, m[1]) else [(1, m[1], x0, cut)]) + [(2, m[2], cut, x1)]


def plain_printed(words):
    """words of one page: dicts."""
    ws = [w for w in words if w["h"] >= 2]
    lines = {}
    for w in ws:
        lines.setdefault(w["line"], []).append(w["h"])
    kept = []
    for w in ws:
        hs = sorted(lines[w["line"]])
        usual = hs[(len(hs) - 1) // 2]
        label = re.match(ink.LABEL, w["raw"])
        ratio = (w["x1"] - w["x0"]) / max(w["y1"] - w["y0"], 0.1)
        if len(w["raw"]) <= 3 and w["conf"] < 60 and 0.75 <= ratio <= 1.3 and (w["h"] >= 1.15 * usual or re.search(ink.BRACKETS, w["raw"])):
            continue
        if len(w["raw"]) == 1 and w["h"] < 0.7 * usual and w["ink"] > ink.INK_SOLID:
            continue
        tall = len(hs) >= 2 and w["h"] > 1.6 * usual
        pale = w["ink"] < 0.05 or w["conf"] < 80 and w["ink"] < 0.08 or w["conf"] < 60 and tall
        kept.append((w, (pale or w["conf"] < 30 and not w["confirmed"]) and not label))
    zones = [w for w, hand in kept if hand and sum(c.isalnum() for c in w["t"]) >= 2]
    out = []
    for w, hand in kept:
        near = any(w["x0"] < z["x1"] + 3 and w["x1"] > z["x0"] - 3 and w["y0"] < z["y1"] + 3 and w["y1"] > z["y0"] - 3 for z in zones)
        if hand or not re.search(ink.SIGN.replace(r"\p{L}\p{N}_", r"\w"), w["t"]) or re.match(ink.CHECKBOX, w["t"]):
            continue
        if w["conf"] < 90 and w["ink"] < 0.08 and near and not re.match(ink.LABEL, w["raw"]):
            continue
        out.append((w["page"], w["id"], w["part"], w["t"]))
    return out


def test_random_pages(spark):
    rng = random.Random(1)
    rows, want = [], []
    for page in range(60):
        own = []
        for k in range(rng.randrange(1, 40)):
            t = rng.choice(["Aláírás:", "oílNév:", "|Dátum:", "e", "•", "[l", "L]", "szelep", "12", "TÓ", "...", "<", "I"])
            x, y = float(rng.randrange(0, 300)), float(rng.randrange(0, 120))
            own.append({"page": page, "line": int(y // 12), "id": k, "t": t, "h": rng.choice([1.0, 5.0, 9.0, 10.0, 11.0, 18.0]), "conf": rng.randrange(0, 101), "ink": rng.randrange(0, 60) / 100, "confirmed": rng.random() < 0.6, "x0": x, "y0": y, "x1": x + rng.choice([10.0, 12.0, 40.0]), "y1": y + 10})
        rows += own
        parts = [w | {"part": p, "t": t, "raw": t, "x0": a, "x1": b} for w in own for p, t, a, b in plain_unglued(w["t"], w["x0"], w["x1"])]
        want += plain_printed(parts)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "page int, line int, id int, t string, h double, conf int, ink double, confirmed boolean, x0 double, y0 double, x1 double, y1 double")
    cut = ink.unglued(df)
    got = sorted(tuple(r) for r in ink.printed(cut.withColumn("raw", cut["t"])).collect())
    assert got == sorted(want) and 50 < len(got) < len(rows) - 200
