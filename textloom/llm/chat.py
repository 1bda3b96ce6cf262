"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one role are merged by aggregating
the arrays of their texts, and the conversation becomes one string:

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE           one block for each run of one role
    text<|im_next|>text                                       turns merged into a block keep their boundary

Inside roles and texts a backslash is doubled, and every control string, of this template or of the
instruction template (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), gets a backslash after its first
character, so no control string survives in a text; dropping the first backslash of each pair undoes
it. A newline in a role gets a backslash before it.

Defined results: a null text is empty, a null role is the empty role, turns are ordered by turn (nulls first), then
role, then text; repeated rows are turns of their own; rows of a null conv_id form one conversation; an empty table gives no
row. A conversation is one value of a column, so it must fit into a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
_CONTROL = r"<(?=\|im_(?:start|next|end)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row for each conversation of ``turns(conv_id, turn, role, text)``."""
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), "\n", "\\\\\n")
    text = escaped(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A run starts where the role differs from that of the turn before; each run's texts are joined in one step,
    # so a long conversation costs time in proportion to its turns.
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))

    def block(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get("starts", k + 1), F.size("turns")) - start
        texts = F.transform(F.slice("turns", start + 1, length), lambda t: t["text"])
        return F.concat(F.lit(START), F.get("turns", start)["role"], F.lit("\n"), F.array_join(texts, NEXT), F.lit(END + "\n"))

    return turns.withColumn("starts", starts).select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text) parsed from the formatted strings, merged ones apart again."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)
    head = r"(?s)^((?:[^\\\n]|\\.)*)\n"

    def parts(b: Column) -> Column:
        role = unescaped(F.regexp_extract(b, head, 1))
        body = F.regexp_replace(F.regexp_replace(b, head, ""), r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return conversations.select("conv_id", "formatted", F.flatten(F.transform(blocks, parts)).alias("turns"))


def loss_text(turns: Column, loss_role: str = "assistant") -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == loss_role), lambda t: t["text"]), "")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns, computed from the formatted strings alone."""
    return (
        read_back(conversations)
        .select("conv_id", "formatted", "turns", loss_text(F.col("turns")).alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


#: The conversation that the contract adds: control strings of another template inside both texts.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_planted(turns: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in turns.schema}
    rows = turns.sparkSession.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    cols = ["conv_id", "turn", "role", "text"]
    return turns.select(*cols).unionByName(rows.select(*[F.col(c).cast(kinds[c]) for c in cols]))


_SQL_ESC = r"""regexp_replace(replace(coalesce({c}, ''), '\', '\\'), '(<)(\|im_(?:start|next|end)\|>|/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"""
ORACLE = f"""
with rows as (
    select conv_id, turn, role, text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        {_SQL_ESC.format(c="role")} as role_esc, {_SQL_ESC.format(c="text")} as text_esc,
        row_number() over w as k, lag(coalesce(role, '')) over w as prev
    from rows window w as (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, ''))
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    cast(coalesce(sum(case when role = 'assistant' then length(text) else 0 end), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(case when prev is null or prev <> role then 12 + length(role_esc) + 1 + 11 else 11 end + length(text_esc)) as bigint) as formatted_chars
from t group by conv_id
"""
