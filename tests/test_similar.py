"""The whole similarity join against brute force."""

import difflib
import re
from collections import Counter

import pandas as pd

from textloom.operators import similar
from textloom.plans import catalogue


def brute(texts):
    """(id, probe, ratio) for texts {text: id}, by loops."""
    words = {i: set(re.findall(r"[^\W\d_]{4,}", t.lower())) for t, i in texts.items()}
    df = Counter(w for ws in words.values() for w in ws)
    by_id = {i: t for t, i in texts.items()}
    probes = sorted(i for i in by_id if i % 20 == 0)
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def template(t):
        n = re.findall("[0-9]+", t)
        return re.sub("[0-9]+", "§", t) if len(t) <= 120 and 1 <= len(n) <= 4 and not re.search("[0-9] [a-z]", t) else None

    out = {}
    for i, t in by_id.items():
        same = [p for p in probes if template(t) is not None and template(by_id[p]) == template(t)]
        if same and min(same) != i:
            out[i] = (min(same), ratio(by_id[min(same)], t))
    for p in probes:
        common = sorted(((-len([w for w in words[p] & ws if df[w] < similar.MOST_TEXTS]), i) for i, ws in words.items() if i != p))
        for _, i in [x for x in common if x[0] < 0][: similar.TOP]:  # probes come in their order, so the first one counts
            if i not in out:
                r = ratio(by_id[p], by_id[i])
                if r >= 0.8:
                    out[i] = (p, r)
    return {(i, p, round(r, 6)) for i, (p, r) in out.items()}


def test_similar_ratio(spark, tmp_path):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").iloc[:60]
    lines = ["Pump of the third loop is at 12 bar today", "Pump of the third loop is at 97 bar today", "Pump of the third loop is at 12 bar here today", "Pressure of loop: 12", "Pressure of loop: 97", "Pressure of loop: 5", "ab", "", "x" * 300 + " yyyy", "x" * 300 + " yyyy z"]
    more = pd.DataFrame({"doc_id": range(100, 104), "text": ["\n".join(lines), "\n".join(reversed(lines)), None, "Pressure of loop: 44"], "lang": "en", "source": "s", "n_chars": 1})
    both = pd.concat([docs, more])
    both.to_parquet(tmp_path / "documents.parquet")
    texts = {}
    for d, t in zip(both.doc_id, both.text, strict=True):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line:
                texts[line] = min(texts.get(line, (d, k)), (d, k))
    texts = {line: n for n, (line, _) in enumerate(sorted(texts.items(), key=lambda x: x[1]), 1)}  # a text's number is its first segment's place
    got = {(r.id, r.probe, r.ratio) for r in catalogue.queries()["similar_ratio"](spark, str(tmp_path)).collect()}
    assert got == brute(texts) and len(got) >= 5
