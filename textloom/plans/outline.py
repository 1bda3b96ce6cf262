"""Queries over headings and lists; segments are blocks, lists are runs of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import outline
from textloom.plans.documents import SEG, seg
from textloom.plans.registry import Registry

query = Registry()

_HEADS = f"""(select doc, seg as ord, case when n % 3 = 0 or n < 60 then 'h' else 'p' end as kind, 1 + seg % 4 as level, n % 5 = 0 as bold, 1 + n // 90 as lines,
    case when n % 4 < 2 and seg > 0 then case when doc % 2 = 0 then seg // 9 + 1 || '.' || seg % 9 + 1 || case when seg % 3 > 0 then '. ' else ' ' end else seg % 7 + 1 || ' ' end else '' end || text || case when n % 23 = 0 then ':' else '' end as text from (select *, length(text) as n from {SEG} where text <> ''))"""


def heads(spark, d):
    n, q = F.length("text"), F.col("seg")
    number = F.when(F.col("doc") % 2 == 0, F.concat((F.floor(q / 9) + 1).cast("string"), F.lit("."), (q % 9 + 1).cast("string"), F.when(q % 3 > 0, ". ").otherwise(" "))).otherwise(F.concat((q % 7 + 1).cast("string"), F.lit(" ")))
    text = F.concat(F.when((n % 4 < 2) & (q > 0), number).otherwise(""), "text", F.when(n % 23 == 0, ":").otherwise(""))
    return seg(spark, d).where("text <> ''").select("doc", q.alias("ord"), F.when((n % 3 == 0) | (n < 60), "h").otherwise("p").alias("kind"), (1 + q % 4).alias("level"), (n % 5 == 0).alias("bold"), (1 + F.floor(n / 90)).alias("lines"), text.alias("text"))


_REAL = f"""(with b as (select *, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s', 1) as num, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as len from {_HEADS}),
    k as (select *, kind = 'h' and not bold and len > 0 and (len >= case when num <> '' then 150 else 80 end or lines >= case when num <> '' then 3 else 2 end or ends_with(trim(regexp_replace(text, '\\s+', ' ', 'g')), ':')) as body from b),
    d as (select *, case when kind = 'h' and not body and num <> '' then len(string_split(num, '.')) end as depth from k),
    s as (select *, count(case when depth <> level then 1 end) over (partition by doc) * 3 >= count(depth) over (partition by doc) as wrong from d)
    select doc, ord, case when body then 'p' else kind end as kind, case when body then null when depth is not null and wrong then least(depth, 6) else level end as level, text from s)"""


@query(f"select doc, cast(ord as integer) as ord, kind, cast(level as integer) as level from {_REAL}")
def headings_mended(spark, d):
    return outline.real_headings(heads(spark, d)).select("doc", "ord", "kind", "level")


@query(f"""with h as materialized (select doc, ord, least(level, 5) as lv, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)(\\.?)\\s', 1) as typed, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)(\\.?)\\s', 2) as dot from {_REAL} where kind = 'h'),
    x as (select h.*, k, max(case when lv < k then ord end) over (partition by doc, k order by ord) as cut from h, range(1, 6) as r(k)),
    n as (select doc, ord, lv, k, sum(case when lv = k then 1 else 0 end) over (partition by doc, k, cut order by ord) as c from x),
    m as (select doc, ord, string_agg(c, '.' order by k) as number from n where k <= lv group by 1, 2),
    a as (select doc, count(*) filter (typed = number) >= 0.9 * count(*) as automatic from h join m using (doc, ord) group by 1),
    t as (select doc, list_sort(list(lv)) as dotted from (select doc, cast(lv as integer) as lv from h where typed <> '' group by 1, 2 having 2 * count(*) filter (dot = '.') > count(*)) group by 1)
    select doc, automatic, coalesce(dotted, []) as dotted from a left join t using (doc)""")
def heading_numbers(spark, d):
    """Whether automatic numbering gives a document's headings their numbers, and the levels with a dot."""
    return outline.numbering_styles(outline.real_headings(heads(spark, d)).where("kind = 'h'"))


_ITEMS = f"""(select doc, seg // 9 as list, seg % 9 as item, 1 + (seg // 9) % 3 as start, case when length(text) % 7 = 3 then case (seg // 3) % 4 when 0 then 'Рисунок ' || seg || ' – ' when 1 then 'fig. ' || seg || ' ' when 2 then seg || '. ÁBRA ' else 'Table' || seg || ' ' end else '' end || text as text, length(text) % 5 > 0 as pictures from {SEG} where text <> '')"""


@query(f"""with c as (select *, pictures and regexp_matches(text, '^\\s*((Рис(унок|\\.)|Таблица|Figure|Fig\\.|Table|Abbildung|Abb\\.|Tabelle)\\s*[0-9]|[0-9]+\\.\\s*(ábra|táblázat))', 'i') as caption from {_ITEMS})
    select doc, cast(list as bigint) as list, cast(item as integer) as item, caption, case when not caption then cast(sum(case when caption then 1 else 0 end) over w as bigint) end as part, case when not caption then cast(start + sum(case when caption then 0 else 1 end) over w - 1 as bigint) end as number
    from c window w as (partition by doc, list order by item)""")
def captions_out_of_lists(spark, d):
    q, n = F.col("seg"), F.length("text")
    k = q.cast("string")
    lead = F.get(F.array(F.concat(F.lit("Рисунок "), k, F.lit(" – ")), F.concat(F.lit("fig. "), k, F.lit(" ")), F.concat(k, F.lit(". ÁBRA ")), F.concat(F.lit("Table"), k, F.lit(" "))), (F.floor(q / 3) % 4).cast("int"))
    items = seg(spark, d).where("text <> ''").select("doc", F.floor(q / 9).alias("list"), (q % 9).alias("item"), (1 + F.floor(q / 9) % 3).alias("start"), F.concat(F.when(n % 7 == 3, lead).otherwise(""), "text").alias("text"), (n % 5 > 0).alias("pictures"))
    return outline.captions_unlisted(items).select("doc", "list", "item", "caption", "part", "number")


_LABELS = ("i.", "ii.", "iii.", "iv.", "v.", "vi.")


@query(f"""with i as (select doc, seg // 4 as list, seg % 4 as item, case (doc + seg // 4) % 8 when 0 then '– ' when 1 then seg % 4 + 3 || '. ' when 2 then [{", ".join(f"'{x}'" for x in _LABELS)}][seg % 4 + 1] || ' ' when 3 then chr(97 + seg % 4) || ') ' when 4 then chr(68 + seg % 4) || '.) ' when 5 then upper([{", ".join(f"'{x}'" for x in _LABELS)}][seg % 4 + 1]) || ' ' when 6 then (seg % 4) * 2 || '. ' else '' end || text as text from {SEG} where text <> ''),
    m as (select *, row_number() over w as nth, regexp_extract(text, '^\\s*([0-9]{{1,3}}|[A-Za-z]|[ivxIVX]{{2,5}})(\\.\\)|[.)])(\\s|$)', 1) as mark, regexp_extract(text, '^\\s*([0-9]{{1,3}}|[A-Za-z]|[ivxIVX]{{2,5}})(\\.\\)|[.)])(\\s|$)', 2) as suffix, regexp_matches(text, '^\\s*[–—-]\\s') as dash from i window w as (partition by doc, list order by item)),
    v as (select *, case when mark similar to '[0-9]+' then cast(mark as integer) end as d, list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], lower(mark)) as r, case when length(mark) = 1 and not mark similar to '[0-9]' then ascii(lower(mark)) - 96 end as l from m),
    g as (select doc, list, count(*) as n, bool_and(dash) as dashes, min_by(suffix, item) as suffix, bool_and(mark <> '') as marked, bool_and(d is not null) as digits, bool_and(mark = lower(mark)) as low, bool_and(mark = upper(mark)) as up, bool_and(coalesce(r = nth, false)) as roman, bool_and(l is not null) as letters,
        max(d) - min(d) = count(*) - 1 and bool_and(coalesce(d - nth = (d0 - 1), false)) as dsteps, bool_and(coalesce(l - nth = (l0 - 1), false)) as lsteps
      from (select *, first_value(d) over w as d0, first_value(l) over w as l0 from v window w as (partition by doc, list order by item)) group by 1, 2),
    k as (select *, case when dashes then 'Dash' when not marked then null when digits then case when dsteps then 'Decimal' end when roman and n > 1 and low then 'LowerRoman' when roman and n > 1 and up then 'UpperRoman' when letters and low then case when lsteps then 'LowerAlpha' end when letters and up then case when lsteps then 'UpperAlpha' end end as kind from g)
    select doc, cast(list as bigint) as list, kind, case when not dashes then suffix end as suffix from k where kind is not null""")
def marks_typed_in_lists(spark, d):
    q = F.col("seg")
    k = (q % 4).cast("int")
    roman = F.get(F.array(*map(F.lit, _LABELS)), k)
    case = (F.col("doc") + F.floor(q / 4)) % 8
    char = lambda first: F.char(F.lit(first) + k)
    lead = (
        F.when(case == 0, "– ").when(case == 1, F.concat((k + 3).cast("string"), F.lit(". "))).when(case == 2, F.concat(roman, F.lit(" "))).when(case == 3, F.concat(char(97), F.lit(") ")))
        .when(case == 4, F.concat(char(68), F.lit(".) "))).when(case == 5, F.concat(F.upper(roman), F.lit(" "))).when(case == 6, F.concat((k * 2).cast("string"), F.lit(". "))).otherwise("")
    )
    return outline.typed_marks(seg(spark, d).where("text <> ''").select("doc", F.floor(q / 4).alias("list"), k.alias("item"), F.concat(lead, "text").alias("text")))


def listed_blocks(spark, d):
    """Two of seven segments are paragraphs behind a list of two items; some ends of last items are drawn below them."""
    q, n = F.col("seg"), F.length("text")
    k, home = q % 7, F.floor(q / 7)
    inside = k < 5
    low = (n % 3 == 0) & (k == 4)
    y = F.when(low, 202.0 + n % 4 * 20).otherwise(100.0 + k * 20)
    page = F.floor(home / 3)
    return seg(spark, d).where("text <> ''").select("doc", q.cast("long").alias("ord"), F.when(inside, home).alias("list"), F.when(inside, F.floor(k / 3)).alias("item"), F.when(n % 11 == 0, "table").otherwise("p").alias("kind"), page.alias("page"), (y + home % 3).alias("top"), (y + home % 3 + 14).alias("bottom"))


@query()
def list_tails_moved(spark, d):
    """Ends of lists that stand below what follows; no SQL: tests hold it against plain loops."""
    return outline.tails_moved(listed_blocks(spark, d)).select("doc", "ord", "place")
