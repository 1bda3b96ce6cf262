"""Answers of a model as rows: requests of many rows, tolerant reading of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let

#: An object that is no JSON, by its keys (fixed pattern).
_LOOSE = r'(?s)^\{\s*"n"\s*:\s*"?([0-9]+)"?\s*,\s*"t"\s*:\s*"(.*)"\s*,\s*"lang"\s*:\s*"([^"]*)"\s*\}'


def answer_objects(c: Column) -> Column:
    """Objects of an answer, array of (n, t, lang), read one by one: what a broken answer got to is kept.

    An object runs from ``{"`` to the next one. One that is no JSON, as with quotes inside its text, is read by its keys; a
    torn tail is left out. Of several objects of one number the last counts.
    """
    pieces = F.filter(F.split(c, r'(?=\{\s*")'), lambda p: p.rlike(r'^\{\s*"'))

    def read(p: Column) -> Column:
        whole = F.regexp_extract(p, r'(?s)^(\{.*\})', 1)
        told = lambda n, t, lang: F.struct(n.try_cast("int").alias("n"), t.alias("t"), lang.alias("lang"))
        by_key = told(*[F.regexp_extract(p, _LOOSE, k) for k in (1, 2, 3)])
        made = {"o": F.from_json(whole, "n string, t string, lang string")}
        return let(made, lambda v: F.when(v["o"]["n"].isNull(), by_key).otherwise(told(v["o"]["n"], v["o"]["t"], v["o"]["lang"])))

    found = F.filter(F.transform(pieces, read), lambda o: o["n"].isNotNull())
    # by number, the last one first; what follows one of the same number goes
    ranked = F.array_sort(F.transform(found, lambda o, i: F.struct(o["n"].alias("n"), (-i).alias("i"), o.alias("o"))))
    last = let({"r": ranked}, lambda v: F.filter(v["r"], lambda x, k: (k == 0) | (F.get(v["r"], k - 1)["n"] != x["n"])))
    return F.transform(F.array_sort(F.transform(last, lambda x: F.struct((-x["i"]).alias("i"), x["o"].alias("o")))), lambda x: x["o"])


def requests(rows: DataFrame, key: str, pack: Column, *fields: str) -> DataFrame:
    """One request for each pack of ``key``: (key, pack, request), a JSON array of (n, fields) in the order of n."""
    item = F.struct("n", *fields)
    return rows.groupBy(key, pack.alias("pack")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("request"))


def answered(requests_: DataFrame, key: str, kinds: str) -> DataFrame:
    """Rows of requests or answers: (key, n, fields)."""
    return requests_.select(key, F.explode(F.from_json("request", f"array<struct<n: long, {kinds}>>")).alias("o")).select(key, "o.*")
