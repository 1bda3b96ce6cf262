"""Alignment of sequences: two readings of a page, answers and their labels, pages of two builds."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters and the Cyrillic ones that look alike (fixed values).
LOOK_ALIKE = str.maketrans("aeopcyxAEOPCYXBKMHT", "аеорсухАЕОРСУХВКМНТ")
OWN, OTHER = 0.6, 0.8
BACK, AHEAD, JUMP, LEAST_SHARED, LEAST_WORDS = 1, 7, 0.04, 0.2, 5


def coded(word: str) -> bool:
    """Digits, two capitals, or a mark other than a stop inside: the second reader is better at these."""
    return any(c.isdigit() for c in word) or sum(c.isupper() for c in word) >= 2 or not word.strip(".,;:!?()-").isalpha()


def _normal(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


#: Runs of this number or fewer are looked at one by one, more as arrays.
FEW_RUNS = 64


def _longest(low_a: int, high_a: int, low_b: int, high_b: int, runs: np.ndarray) -> tuple[int, int, int, np.ndarray | list]:
    """The length and place of a part's block, 1 if no run of two reaches into the part, and the runs that do."""
    i, j, n = runs
    ahead = np.maximum(np.maximum(low_a - i, low_b - j), 0)
    i, j, n = i + ahead, j + ahead, n - ahead
    n = np.minimum(np.minimum(n, high_a - i), high_b - j)
    kept = n > 1
    if not kept.any():
        return 1, 0, 0, []
    inside = runs[:, kept]
    best = n.max()
    at = np.flatnonzero(n == best)
    at = at[i[at] == i[at].min()]
    k = at[j[at].argmin()]
    return int(best), int(i[k]), int(j[k]), inside if inside.shape[1] > FEW_RUNS else inside.T.tolist()


def _blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """difflib's matching blocks of two sequences without junk: (in a, in b, length) in order, neighbouring ones joined.

    Runs of two members or more that cannot be made longer are found in one pass over pairs of neighbours; each part left and right of a block
    only looks at the runs that reach into it. The block of a part is its longest run, of equal ones the first in a, then in b, as difflib has
    it. In a part without such runs blocks are single members: the first of a that the rest of b has, and so on behind it.
    """
    if a == b:
        return [(0, 0, len(a))] if a else []
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    pairs: dict = {}
    for j, x in enumerate(zip(b, b[1:], strict=False)):
        pairs.setdefault(x, []).append(j)
    runs: list[list[int]] = []
    before: dict[int, list[int]] = {}
    for i, x in enumerate(zip(a, a[1:], strict=False)):
        now = {}
        for j in pairs.get(x, ()):
            run = before.get(j - 1)
            if run is None:
                run = [i, j, 1]
                runs.append(run)
            run[2] += 1
            now[j] = run
        before = now
    found, parts = [], [(0, len(a), 0, len(b), runs if len(runs) <= FEW_RUNS else np.array(runs, np.int32).T)]
    while parts:
        low_a, high_a, low_b, high_b, near = parts.pop()
        if isinstance(near, np.ndarray):
            best, at_a, at_b, inside = _longest(low_a, high_a, low_b, high_b, near)
            near = []
        else:
            best, at_a, at_b, inside = 1, 0, 0, []
        for run in near:
            i, j, n = run
            if i < low_a or j < low_b:
                ahead = max(low_a - i, low_b - j)
                i, j, n = i + ahead, j + ahead, n - ahead
            if i + n > high_a or j + n > high_b:
                n = min(high_a - i, high_b - j)
            if n > 1:
                inside.append(run)
                if n > best or n == best and (i, j) < (at_a, at_b):
                    best, at_a, at_b = n, i, j
        if best > 1:
            found.append((at_a, at_b, best))
            parts.append((low_a, at_a, low_b, at_b, inside))
            parts.append((at_a + best, high_a, at_b + best, high_b, inside))
            continue
        for i in range(low_a, high_a):
            if low_b == high_b:
                break
            own = places.get(a[i])
            if own is not None:
                k = bisect_left(own, low_b)
                if k < len(own) and own[k] < high_b:
                    found.append((i, own[k], 1))
                    low_b = own[k] + 1
    found.sort()
    out: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


class _Told(dict):
    """What is told of a word, once: its letters and digits, whether it is coded, whether it has letters or digits."""

    def __missing__(self, word: str) -> tuple[str, bool, bool]:
        low = word.lower()
        if word.isalpha() and low.isalnum():  # most words: no digits and no marks
            told = low, not (low == word or word[1:].islower()) and coded(word), True
        else:
            told = _normal(word), coded(word), any(c.isalnum() for c in word)
        self[word] = told
        return told


def merged_words(first: list[str], second: list[str], told: _Told | None = None) -> list[str]:
    """The first reader's words with the second's where it is better.

    Equal stretches and replacements of one length are chosen word by word: coded words and marks from the second, plain words
    from the first. An uneven replacement takes the second's words, as one, if any is coded. Words that only
    the first has stay unless they are marks alone; words that only the second has are put to the word before.
    """
    told = _Told() if told is None else told
    out: list[str | None] = list(first)
    one, other = [told[w] for w in first], [told[w] for w in second]
    blocks = _blocks([t[0] for t in one], [t[0] for t in other])

    def choose(i: int, k: int, n: int) -> None:
        for a in range(n):
            y = second[k + a]
            if out[i + a] != y:
                s, t = one[i + a], other[k + a]
                if s[1] or t[1] or not (s[2] and t[2]):
                    out[i + a] = y

    i = k = 0
    for at, to, n in [*blocks, (len(first), len(second), 0)]:
        # what lies before the block, then the block
        if i < at and k < to:
            if at - i == to - k:
                choose(i, k, at - i)
            elif any(t[1] for t in one[i:at]) or any(t[1] for t in other[k:to]):
                out[i:at] = [" ".join(second[k:to]), *[None] * (at - i - 1)]
        elif i < at:
            out[i:at] = [w if t[0] else None for w, t in zip(first[i:at], one[i:at], strict=True)]
        elif k < to and i > 0:
            out[i - 1] = " ".join([*([out[i - 1]] if out[i - 1] else []), *second[k:to]])
        choose(at, to, n)
        i, k = at + n, to + n
    return [w for w in out if w is not None]


def merged_readings(first: Column, second: Column) -> Column:
    """Arrays of words of two readers to one, in Arrow batches: the alignment runs inside one page, a batch's words are told once."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        told = _Told()
        return pd.Series([merged_words(list(x), list(y), told) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(batch, "array<string>")(first, second)


def likeness(a: Column, b: Column) -> Column:
    """difflib's ratio after folding look-alike letters and case."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        fold = lambda t: (t or "").translate(LOOK_ALIKE).lower()
        return pd.Series([SequenceMatcher(None, fold(i), fold(j)).ratio() for i, j in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(batch, "double")(a, b)


def realigned(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (pic, n, t) to the labels (pic, n, t) of a picture that they belong to: (pic, n, t, from_n).

    An answer that is like its own label (OWN) stays. The others go, in the order of their numbers, to the label that is free and most
    like them (OTHER; the first of equal ones). Empty answers stay at free numbers. Likenesses are made by one join inside a
    picture of what the first step left over; the assignment folds over a picture's own candidates.
    """
    a = answers.select("pic", F.col("n").alias("from_n"), F.trim(F.coalesce("t", F.lit(""))).alias("t"))
    own = a.join(labels.select("pic", F.col("n").alias("from_n"), F.col("t").alias("label")), ["pic", "from_n"], "left")
    own = own.withColumn("fits", F.col("label").isNotNull() & (likeness("t", "label") >= OWN))
    stay = own.where("fits").select("pic", F.col("from_n").alias("n"), "t", "from_n")
    left = own.where("not fits").select("pic", "from_n", "t")
    free = labels.join(stay.select("pic", "n"), ["pic", "n"], "left_anti")
    pairs = left.where("t <> ''").join(free.withColumnRenamed("t", "label"), "pic").withColumn("s", likeness("t", "label")).where(F.col("s") >= OTHER)
    ranked = pairs.groupBy("pic", "from_n").agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "n"))).alias("to"))
    lists = ranked.groupBy("pic").agg(F.array_sort(F.collect_list(F.struct("from_n", "t", "to"))).alias("a"))
    taken = F.lit(None).cast("array<struct<n: int, t: string, from_n: int>>")
    taken = F.coalesce(taken, F.array().cast("array<struct<n: int, t: string, from_n: int>>"))

    def assign(acc: Column, x: Column) -> Column:
        open_ = F.filter(x["to"], lambda c: ~F.exists(acc, lambda z: z["n"] == c["n"]))
        made = F.struct(F.get(open_, F.lit(0))["n"].cast("int").alias("n"), x["t"].alias("t"), x["from_n"].cast("int").alias("from_n"))
        return F.when(F.size(open_) > 0, F.concat(acc, F.array(made))).otherwise(acc)

    moved = lists.select("pic", F.explode(F.aggregate("a", taken, assign)).alias("o")).select("pic", "o.*")
    empty = left.where("t = ''").select("pic", F.col("from_n").alias("n"), "t", "from_n")
    placed = stay.unionByName(moved)
    return placed.unionByName(empty.join(placed.select("pic", "n"), ["pic", "n"], "left_anti"))


def monotone_pages(a: list[list[str]], b: list[list[str]]) -> list[int]:
    """For each page of ``a`` the page of ``b`` (from 0) with the largest share of its words, less JUMP for each page away from the expected one.

    The match moves within BACK pages back and AHEAD on, and only if it shares LEAST_SHARED; pages of fewer than LEAST_WORDS
    different words keep the last match. Of equal pages the first counts.
    """
    out, at = [], 0
    sets = [set(x) for x in b]
    for k, page in enumerate(a):
        own = set(page)
        if len(own) >= LEAST_WORDS and sets:
            expected = min(at + 1, len(b) - 1) if k else 0
            near = range(max(0, at - BACK), min(at + AHEAD + 1, len(b)))
            best = max(near, key=lambda m: len(own & sets[m]) / len(own) - JUMP * abs(m - expected), default=at)
            if len(own & sets[best]) >= LEAST_SHARED * len(own):
                at = best
        out.append(at)
    return out


def matched_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, other) for pages(doc, side, page, words), side 0 matched with side 1; a document's pages are one row."""
    lists = pages.groupBy("doc", "side").agg(F.array_sort(F.collect_list(F.struct("page", "words"))).alias("p"))
    both = lists.groupBy("doc").agg(*[F.max(F.when(F.col("side") == k, F.col("p.words"))).alias(f"p{k}") for k in (0, 1)]).where("p0 is not null")

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        lists_of = lambda x: [] if x is None else [list(w) for w in x]
        return pd.Series([monotone_pages(lists_of(x), lists_of(y)) for x, y in zip(a, b, strict=True)])

    found = F.pandas_udf(batch, "array<int>")("p0", "p1")
    return both.select("doc", F.posexplode(found).alias("page", "other"))
