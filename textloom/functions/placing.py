"""Formatting and code put back into a text by what stands where."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let

#: Letters that only Hungarian text has among the languages here (fixed values).
HU_LETTERS = "áéíóöőúüűÁÉÍÓÖŐÚÜŰ"
PART = "array<struct<key:string,text:string>>"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tab_restored(src: Column, out: Column) -> Column:
    """'label ⇥ value' whose target lost its tab gets it back before the value, if the value ends the target word for word."""
    value = _stripped(F.split_part(src, F.lit("\t"), F.lit(2)))
    end = F.regexp_replace(out, r"\s+$", "")
    before = F.regexp_replace(F.left(end, F.length(end) - F.length(value)), r"\s+$", "")
    one = F.length(src) - F.length(F.replace(src, F.lit("\t"))) == 1
    fits = one & ~F.contains(out, F.lit("\t")) & (value != "") & F.endswith(end, value) & (F.length(end) > F.length(value))
    return F.when(fits, F.concat(before, F.lit("\t"), value)).otherwise(out)


def code_kept(src: Column, out: Column) -> Column:
    """Code without Hungarian letters stays as in the source; line by line if there are as many lines; a placeholder keeps its brackets."""
    word = F.translate(src, HU_LETTERS, "") != src
    a, b = F.split(src, "\n"), F.split(F.coalesce(out, F.lit("")), "\n")
    lines = F.array_join(F.zip_with(a, b, lambda x, y: F.when(F.translate(x, HU_LETTERS, "") != x, y).otherwise(x)), "\n")
    bare = _stripped(src)
    lead, tail = F.regexp_extract(src, r"^\s*", 0), F.regexp_extract(src, r"\s*$", 0)
    bracketed = F.startswith(bare, F.lit("<")) & F.endswith(bare, F.lit(">")) & ~F.startswith(_stripped(out), F.lit("<"))
    return F.when(~word, src).when((F.size(a) > 1) & (F.size(a) == F.size(b)), lines).when(bracketed, F.concat(lead, F.lit("<"), _stripped(out), F.lit(">"), tail)).otherwise(out)


def _base(text: Column, parts: Column) -> Column:
    """The place of the longest part that is not in the text word for word; of all parts, if each one is."""
    sized = F.transform(parts, lambda p, i: F.struct(F.length(_stripped(p["text"])).alias("n"), (-i).alias("i"), ((_stripped(p["text"]) != "") & ~F.contains(text, _stripped(p["text"]))).alias("told")))
    told = F.filter(sized, lambda x: x["told"])
    return -F.array_max(F.when(F.size(told) > 0, told).otherwise(sized))["i"]


def _with_base(text: Column, parts: Column, body) -> Column:
    """``body`` of a struct (text, parts, base, key), each computed once."""
    return let({"text": text, "parts": parts}, lambda v: let({"text": v["text"], "parts": v["parts"], "base": _base(v["text"], v["parts"])}, lambda b: let({"text": b["text"], "parts": b["parts"], "base": b["base"], "key": F.get(b["parts"], b["base"])["key"]}, body)))


def all_verbatim(text: Column, parts: Column) -> Column:
    """Every part of another key than the base is in the text word for word."""
    return _with_base(text, parts, lambda v: F.forall(v["parts"], lambda p: (p["key"] == v["key"]) | (_stripped(p["text"]) == "") | F.contains(v["text"], _stripped(p["text"]))))


def restyled(text: Column, parts: Column) -> Column:
    """The text in pieces (key, text) of the parts' keys, ``parts`` an array of structs (key, text).

    What is in the text word for word, three characters or more, takes its part's key where it first occurs, unless an earlier part has that
    place; all else takes the key of the base. The pieces joined are the text.
    """
    return _with_base(text, parts, lambda v: let({"text": v["text"], "key": v["key"], "spans": _spans(v)}, _pieces))


def _spans(v: Column) -> Column:
    span = "array<struct<first:int,last:int,key:string>>"
    places = F.transform(v["parts"], lambda p, i: F.struct(i.alias("i"), p["key"].alias("key"), F.length(_stripped(p["text"])).alias("n"), F.position(_stripped(p["text"]), v["text"]).alias("first")))

    def add(acc: Column, x: Column) -> Column:
        last = x["first"] + x["n"]
        free = ~F.exists(acc, lambda a: (a["first"] < last) & (x["first"] < a["last"]))
        take = (x["i"] != v["base"]) & (x["n"] >= 3) & (x["key"] != v["key"]) & (x["first"] > 0) & free
        return F.when(take, F.concat(acc, F.array(F.struct(x["first"].alias("first"), last.alias("last"), x["key"].alias("key"))))).otherwise(acc)

    return F.array_sort(F.aggregate(places, F.array().cast(span), add))


def _pieces(v: Column) -> Column:
    text, key, spans = v["text"], v["key"], v["spans"]
    piece = lambda k, a, b: F.struct(k.alias("key"), F.substr(text, a, b - a).alias("text"))
    whole = F.array(piece(key, F.lit(1), F.length(text) + 1))

    def around(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(spans, i - 1)["last"], F.lit(1))
        own = F.array(piece(key, before, s["first"]), piece(s["key"], s["first"], s["last"]))
        return F.when(i == F.size(spans) - 1, F.concat(own, F.array(piece(key, s["last"], F.length(text) + 1)))).otherwise(own)

    pieces = F.filter(F.flatten(F.transform(spans, around)), lambda p: p["text"] != "")
    return F.when(F.size(spans) == 0, whole).otherwise(pieces)
