"""Field runs of office paragraphs: what a field prints and the program computes anew is no text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators.packed import flat, packed

#: Instructions of fields that are computed anew when a document is opened (fixed values).
PAGE_FIELDS = ("PAGE", "NUMPAGES", "SECTIONPAGES")
DATA_FIELDS = ("DOCPROPERTY", "REVNUM", "NUMWORDS", "NUMCHARS", "FILESIZE", "DATE", "TIME", "SAVEDATE", "PRINTDATE", "CREATEDATE", "REF", "NOTEREF")
#: Check boxes and bullets that stand for themselves, and fonts whose letters are signs (fixed values).
SIGNS, SIGN_FONTS = "-☐☒□■▪●○✓✔", ("Wingdings", "Symbol", "Webdings")


def named(instruction: Column, names: tuple[str, ...]) -> Column:
    """The instruction's first word is one of the names; words end where letters, digits and underscores do."""
    first = F.regexp_extract(instruction, r"^\s*([\p{L}\p{N}_]+)", 1)
    return first.isin(list(names))


def sign_run(text: Column, font: Column) -> Column:
    """A run of signs only, or in a font of signs."""
    signs = text.rlike(rf"^[{SIGNS}\s]+$") & (F.trim(text) != "")
    return signs | F.coalesce(font.rlike("|".join(SIGN_FONTS)), F.lit(False))


#: Kinds of runs as numbers, and what is told of a text by itself (bits): in a page field, signs only, without letters.
_KINDS = {"text": 0, "begin": 1, "separate": 2, "end": 3, "instr": 4}
_PAGE, _SIGN, _BARE = 1, 2, 4


def _results(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """The texts of a part that are results of a field, with its instruction, and those that are told by themselves."""
    seq, kind, told = (flat(t, c).to_numpy(zero_copy_only=False) for c in ("seq", "kind", "told"))
    order = np.argsort(seq, kind="stable")
    kind = kind[order]
    marks, texts = np.flatnonzero(kind), np.flatnonzero(kind == 0)
    parts = flat(t, "instruction").take(pa.array(order[marks])).to_pylist()
    # open fields are a stack; for each mark the field that is open behind it, if that is past its separator
    stack: list[int] = []
    instructions: list[list[str]] = []
    past: list[bool] = []
    state = [-1]
    for k, part in zip(kind[marks].tolist(), parts, strict=True):
        if k == 1:
            stack.append(len(past))
            past.append(False)
            instructions.append([])
        elif stack:
            if k == 3:
                stack.pop()
            elif k == 2:
                past[stack[-1]] = True
            elif part is not None:
                instructions[stack[-1]].append(part)
        state.append(stack[-1] if stack and past[stack[-1]] else -1)
    field = np.array(state)[np.searchsorted(marks, texts)]
    at = order[texts]
    kept = (field >= 0) | (told[at] & (_PAGE | _SIGN) > 0)
    at, field = at[kept], field[kept]
    joined = ["".join(x) for x in instructions]
    found = [joined[f] if f >= 0 else None for f in field.tolist()]
    return pa.Table.from_arrays([pa.repeat(t["part"][0], len(at)), pa.array(seq[at], schema.field("seq").type), pa.array(told[at], pa.int8()), pa.array(found, pa.string())], schema=schema)


def computed_runs(runs: DataFrame) -> DataFrame:
    """Text runs that are no text: (part, seq, why) with why page, data or sign.

    A result of a page field, a result without letters of a data field, or a run of signs. ``runs(part, seq, kind, text, font, simple)``: kind is
    begin, separate, end, instr or text, ``simple`` the instruction of the simple field around a run (else null). Open fields are a stack, where
    an end of nothing counts nothing. A field's instruction is all of its own instruction runs in order; a field that
    is never closed lasts to the end of its part.

    What a run tells by itself is told first, so only that, its kind and instructions are shuffled, once and as arrays of a part.
    """
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in _KINDS.items()]).cast("tinyint")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    told = bit(named(F.col("simple"), PAGE_FIELDS), _PAGE) + bit(sign_run(F.col("text"), F.col("font")), _SIGN) + bit(~F.col("text").rlike(r"\p{L}"), _BARE)
    rows = runs.select("part", "seq", number.alias("kind"), F.when(F.col("kind") == "text", told).otherwise(0).cast("tinyint").alias("told"), F.when(F.col("kind") == "instr", F.col("text")).alias("instruction"))
    kind = lambda c: runs.schema[c].dataType.simpleString()
    out = f"part {kind('part')}, seq {kind('seq')}, told tinyint, instruction string"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    found = packed(rows.where("kind is not null"), ["part"], ["seq", "kind", "told", "instruction"]).groupBy("part").applyInArrow(lambda t: _results(t, schema), out)
    has = lambda n: F.col("told").bitwiseAND(F.lit(n).cast("tinyint")) != 0
    why = F.when(has(_PAGE) | named(F.col("instruction"), PAGE_FIELDS), "page").when(named(F.col("instruction"), DATA_FIELDS) & has(_BARE), "data").when(has(_SIGN), "sign")
    return found.select("part", "seq", why.alias("why")).where("why is not null")
