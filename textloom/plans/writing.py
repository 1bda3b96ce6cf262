"""Queries over formatting, code, syllables and profiles of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import placing as P
from textloom.functions import syllables as S
from textloom.functions import text as X
from textloom.operators import profile
from textloom.operators import words as W
from textloom.plans.blocks import _RULES, rule_boxes
from textloom.plans.documents import SEG, STUB, seg
from textloom.plans.layout import BOXES, boxes
from textloom.plans.registry import Registry

query = Registry()

# -- split words


@query(f"""with b as materialized (select *, case when id % 5 = 0 then t || '|' || length(t) end as raw from {BOXES}), v as materialized (select page, (x0 + x1) / 2 - 15 as x, y0, y1 from {_RULES} where x1 - x0 < 3),
    c as (select b.page, id, min(x) as x from b join v on b.page = v.page and length(t) >= 3 and x > b.x0 + 2 and x < b.x1 - 2 and least(b.y1, v.y1) - greatest(b.y0, v.y0) > 0.5 * (b.y1 - b.y0) group by 1, 2),
    k as (select b.*, x, cast(round_even(length(t) * (x - x0) / (x1 - x0), 0) as integer) as k from b left join c using (page, id)),
    n as (select *, list_filter([k, k - 1, k + 1, k - 2, k + 2], lambda i: i >= 0 and i < length(t) and contains('|Jj[]!lI1', t[i + 1 : i + 1]))[1] as near from k),
    s as (select *, case when raw is not null and length(raw) > length(t) + 1 then t when near is not null then left(t, near) else left(t, k) end as a,
        case when raw is not null and length(raw) > length(t) + 1 then raw[length(t) + 2 :] when near is not null then t[near + 2 :] else t[k + 1 :] end as z from n)
    select page, id, 0 as part, t, x0, x1 from s where x is null union all select page, id, 1, a, x0, x - 1 from s where x is not null and a <> '' union all select page, id, 2, z, x + 1, x1 from s where x is not null and z <> ''""")
def words_split_at_rules(spark, d):
    """Words across a vertical become two."""
    v = rule_boxes(spark, d).where("x1 - x0 < 3").select("page", ((F.col("x0") + F.col("x1")) / 2 - 15).alias("x"), "y0", "y1")
    words = boxes(spark, d).withColumn("raw", F.when(F.col("id") % 5 == 0, F.concat_ws("|", "t", F.length("t"))))
    return W.split_at_rules(words, v).select("page", F.col("id").cast("long").alias("id"), "part", "t", "x0", "x1")


def ink_rows(spark, d):
    """Words of the lines of whole pages and made-up pieces of ink: some words run together, some break in two."""
    lines = boxes(spark, d).groupBy(F.col("page").alias("doc"), F.col("line").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("id", F.length("t").alias("n")))).alias("w"))
    rows = lines.select("doc", "seg", F.transform("w", lambda w: w["n"]).alias("lengths"))
    halves = F.flatten(F.transform("lengths", lambda n, i: F.when((i % 7 == 3) & (n > 4), F.array(n * 3.0, n * 2.5)).otherwise(F.array(n * 5.5 + i % 3))))
    return rows.withColumn("widths", F.filter(halves, lambda w: F.floor(w) % 11 != 7))


@query()
def ink_alignment(spark, d):
    """Words with their pieces of ink; no SQL: tests hold it against all ways of grouping."""
    return ink_rows(spark, d).select("doc", "seg", W.ink_aligned(F.col("lengths"), F.col("widths")).alias("groups"))


# -- formatting put back (a segment's words in three parts of other keys; the target has the second part word for word)

_PARTS = f"""(select doc, seg, p1, p2, p3, case when seg % 3 = 0 then translate(p1, 'aeiouAEIOU', 'eiouaEIOUA') || p2 || p3 when seg % 3 = 1 then p3 || ' ' || p2 || translate(p1, 'aeiouAEIOU', 'eiouaEIOUA') else translate(text, 'aeiouAEIOU', 'eiouaEIOUA') end as out
    from (select doc, seg, text, array_to_string(w[1 : n // 3], ' ') as p1, ' ' || array_to_string(w[n // 3 + 1 : 2 * (n // 3)], ' ') as p2, ' ' || array_to_string(w[2 * (n // 3) + 1 :], ' ') as p3 from (select doc, seg, text, string_split(text, ' ') as w, len(string_split(text, ' ')) as n from {SEG} where text <> '')))"""


def styled(spark, d):
    rows = seg(spark, d).where("text <> ''").withColumn("w", F.split("text", " ")).withColumn("k", F.floor(F.size("w") / 3).cast("int"))
    k, w = F.col("k"), F.col("w")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    rows = rows.select("doc", "seg", "text", part(F.lit(1), k).alias("p1"), F.concat(F.lit(" "), part(k + 1, k)).alias("p2"), F.concat(F.lit(" "), part(2 * k + 1, F.size(w))).alias("p3"))
    stub, case = X.stand_in(F.col("p1")), F.col("seg") % 3
    out = F.when(case == 0, F.concat(stub, "p2", "p3")).when(case == 1, F.concat("p3", F.lit(" "), "p2", stub)).otherwise(X.stand_in(F.col("text")))
    return rows.select("doc", "seg", "p1", "p2", "p3", out.alias("out"))


def _parts():
    return F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("text")) for k, c in (("plain", "p1"), ("code", "p2"), ("bold", "p3"))])


@query(f"""with p as (select *, [{{'k': 'plain', 's': trim(p1), 'i': 0}}, {{'k': 'code', 's': trim(p2), 'i': 1}}, {{'k': 'bold', 's': trim(p3), 'i': 2}}] as ps from {_PARTS}),
    t as (select *, list_filter(ps, lambda x: x.s <> '' and not contains(out, x.s)) as told from p),
    b as (select *, list_reduce(case when len(told) > 0 then told else ps end, lambda a, x: case when length(x.s) > length(a.s) then x else a end) as base from t),
    c as (select *, list_filter(list_transform(ps, lambda x: {{'k': x.k, 'i': x.i, 'a': instr(out, x.s), 'z': instr(out, x.s) + length(x.s)}}), lambda x: x.i <> base.i and x.z - x.a >= 3 and x.a > 0) as c from b),
    s as (select *, list_sort(list_transform(case when len(c) = 2 and c[1].a < c[2].z and c[2].a < c[1].z then c[1:1] else c end, lambda x: {{'a': x.a, 'z': x.z, 'k': x.k}})) as s from c),
    q as (select doc, seg, out, list_filter(case len(s) when 0 then [base.k || ':' || out] when 1 then [base.k || ':' || out[1 : s[1].a - 1], s[1].k || ':' || out[s[1].a : s[1].z - 1], base.k || ':' || out[s[1].z :]]
        else [base.k || ':' || out[1 : s[1].a - 1], s[1].k || ':' || out[s[1].a : s[1].z - 1], base.k || ':' || out[s[1].z : s[2].a - 1], s[2].k || ':' || out[s[2].a : s[2].z - 1], base.k || ':' || out[s[2].z :]] end, lambda x: not regexp_full_match(x, '(plain|code|bold):')) as pieces, ps, base from s)
    select doc, cast(seg as integer) as seg, pieces, len(list_filter(ps, lambda x: x.k <> base.k and x.s <> '' and not contains(out, x.s))) = 0 as verbatim from q""")
def restyled_pieces(spark, d):
    """Targets in pieces of the parts' formatting."""
    told = styled(spark, d)
    pieces = F.transform(P.restyled(F.col("out"), _parts()), lambda p: F.concat_ws(":", p["key"], p["text"]))
    return told.select("doc", "seg", pieces.alias("pieces"), P.all_verbatim(F.col("out"), _parts()).alias("verbatim"))


_CODED = f"(select doc, seg, case seg % 4 when 0 then text || chr(9) || right(text, 5) when 1 then text || chr(10) || 'LogFile=' || seg || chr(10) || 'érték ' || text when 2 then ' <beállít ' || text || '> ' else text end as src, case seg % 4 when 0 then {STUB} || ' ' || right(text, 5) when 1 then {STUB} || chr(10) || 'Файл=' || seg || chr(10) || {STUB} else {STUB} end as out from {SEG} where text <> '')"


@query(f"""select doc, cast(seg as integer) as seg, case when length(src) - length(replace(src, chr(9), '')) = 1 and not contains(out, chr(9)) and regexp_replace(string_split(src, chr(9))[2], '^\\s+|\\s+$', '', 'g') <> '' and ends_with(regexp_replace(out, '\\s+$', ''), regexp_replace(string_split(src, chr(9))[2], '^\\s+|\\s+$', '', 'g'))
      and length(regexp_replace(out, '\\s+$', '')) > length(regexp_replace(string_split(src, chr(9))[2], '^\\s+|\\s+$', '', 'g'))
      then regexp_replace(left(regexp_replace(out, '\\s+$', ''), length(regexp_replace(out, '\\s+$', '')) - length(regexp_replace(string_split(src, chr(9))[2], '^\\s+|\\s+$', '', 'g'))), '\\s+$', '') || chr(9) || regexp_replace(string_split(src, chr(9))[2], '^\\s+|\\s+$', '', 'g') else out end as tabbed,
    case when not regexp_matches(src, '[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]') then src when len(string_split(src, chr(10))) > 1 and len(string_split(src, chr(10))) = len(string_split(out, chr(10)))
        then array_to_string(list_transform(list_zip(string_split(src, chr(10)), string_split(out, chr(10))), lambda x: case when regexp_matches(x[1], '[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]') then x[2] else x[1] end), chr(10))
      when regexp_matches(src, '(?s)^\\s*<.*>\\s*$') and not regexp_matches(out, '^\\s*<') then regexp_extract(src, '^\\s*') || '<' || regexp_replace(out, '^\\s+|\\s+$', '', 'g') || '>' || regexp_extract(src, '\\s*$') else out end as kept from {_CODED}""")
def code_and_tabs_kept(spark, d):
    rows, stub = seg(spark, d).where("text <> ''"), X.stand_in(F.col("text"))
    k, t, end = F.col("seg") % 4, F.col("text"), F.right("text", F.lit(5))
    number = F.col("seg").cast("string")
    src = F.when(k == 0, F.concat(t, F.lit("\t"), end)).when(k == 1, F.concat(t, F.lit("\nLogFile="), number, F.lit("\nérték "), t)).when(k == 2, F.concat(F.lit(" <beállít "), t, F.lit("> "))).otherwise(t)
    out = F.when(k == 0, F.concat(stub, F.lit(" "), end)).when(k == 1, F.concat(stub, F.lit("\nФайл="), number, F.lit("\n"), stub)).otherwise(stub)
    return rows.select("doc", "seg", P.tab_restored(src, out).alias("tabbed"), P.code_kept(src, out).alias("kept"))


# -- syllables and widths (texts become Cyrillic by an exchange of letters)

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстувьыжзАБЦДЕФГХИЙКЛМНОПЯРСТУВЬЫЖЗ"


def cyrillic(t):
    return F.translate(t, _LATIN, _CYRILLIC)


def _marked_sql() -> str:
    out = "w"
    for _ in range(2):
        for a, b in S.RULES:
            out = f"regexp_replace({out}, '({a})({b})', '\\1|\\2', 'gi')"
    return f"regexp_replace(regexp_replace({out}, '^(.)\\|', '\\1'), '\\|(.)$', '\\1')"


@query(f"""with t as (select doc, seg, translate(text, '{_LATIN}', '{_CYRILLIC}') as t from {SEG}),
    p as (select doc, seg, t, unnest(list_zip(string_split_regex(t, '{S.LONG_WORD}'), list_append(regexp_extract_all(t, '{S.LONG_WORD}'), ''))) as z, generate_subscripts(string_split_regex(t, '{S.LONG_WORD}'), 1) as k from t),
    w as (select doc, seg, k, t, z[1] as b, z[2] as w from p)
    select doc, cast(seg as integer) as seg, string_agg(b || case when upper(w) = w and regexp_matches(t, '[а-яё]') or regexp_matches(w, '[а-яё][А-ЯЁ]') then w else replace({_marked_sql()}, '|', chr(173)) end, '' order by k) as soft from w group by 1, 2""")
def soft_hyphens(spark, d):
    t = cyrillic(F.col("text"))
    return seg(spark, d).select("doc", "seg", S.hyphenated(t, F.lit("­")).alias("soft"))


_WIDTHS = ", ".join("({0}, '{1}')".format(w, c.replace("'", "''")) for w, chars in S.HELVETICA.items() for c in chars)


@query(f"""with w(w, c) as (values {_WIDTHS}), t as (select doc, seg, case when seg % 3 = 0 then translate(text, '{_LATIN}', '{_CYRILLIC}') else text end as t from {SEG}),
    c as (select doc, seg, unnest(string_split(t, '')) as c from t where t <> ''), n as (select doc, seg, c, count(*) as n from c group by 1, 2, 3),
    s as (select doc, seg, sum(n * coalesce(w, case when regexp_matches(c, '\\p{{Lu}}') then 720 else 600 end)) as s from n left join w using (c) group by 1, 2)
    select doc, cast(seg as integer) as seg, round(cast(coalesce(s, 0) as double) * (9 + seg % 4) / 1000, 3) as width from t left join s using (doc, seg)""")
def text_widths(spark, d):
    t = F.when(F.col("seg") % 3 == 0, cyrillic(F.col("text"))).otherwise(F.col("text"))
    return seg(spark, d).select("doc", "seg", S.width(t, 9.0 + F.col("seg") % 4, True).alias("width"))


# -- profiles (segments are blocks; their formatting follows their length, the profile is what most of their letters have)

_STYLED = f"""(select doc, seg as ord, n, text, case when n % 19 = 1 then 'figure' when contains(text, ' | ') then 'table' when n % 13 = 2 then 'caption' when starts_with(text, '- ') or n % 17 = 5 then 'item' when n < 46 then 'heading' else 'body' end as kind,
    case when n % 13 = 2 and seg % 2 = 0 then 'Рисунок ' || seg || ' ' || text when n % 13 = 2 then 'Таблица ' || seg || ' ' || text when n % 17 = 5 and seg % 3 = 0 then seg || '. ' || text when n % 53 = 0 then text || ' ( )' else text end as shown
    from (select *, length(text) as n from {SEG} where text <> ''))"""
_FACTS = f"""(with b as materialized (select * from {_STYLED}),
    c as (select *, lag(kind) over w as before, lead(kind) over w as after from b window w as (partition by doc order by ord))
    select doc, ord, kind as role, n, 'font' as fact, null :: double as num, case when n % 41 = 3 then 'Arial' else 'Times' end as text from b
    union all select doc, ord, kind, n, 'size', 10.0 + case when n % 37 = 5 then 0.5 when n % 5 = 0 then 0.2 else 0 end, null from b
    union all select doc, ord, kind, n, 'bold', null, case when (kind = 'heading') <> (n % 43 = 7) then 'yes' else 'no' end from b
    union all select doc, ord, kind, n, 'table_width', 400.0 + n % 9 * 4, null from b where kind = 'table'
    union all select doc, ord, kind, n, 'item_place', 60.0 + n % 4 * 12 + case when n % 23 = 4 then 5 else 0 end, null from b where kind = 'item'
    union all select doc, ord, case when starts_with(shown, 'Рисунок') then 'figure caption' else 'table caption' end, n, 'caption_place', null, case when starts_with(shown, 'Рисунок') then case when before = 'figure' then 'below figure' else 'not below figure' end when after = 'table' then 'above table' else 'not above table' end from c where kind = 'caption' and (starts_with(shown, 'Рисунок') or starts_with(shown, 'Таблица'))
    union all select doc, ord, kind, n, 'typed_number', 1, left(shown, 50) from b where kind = 'item' and regexp_matches(shown, '^\\s*([0-9]+|[A-Za-zА-Яа-я])[.)]\\s') and not regexp_matches(shown, '^\\s*([0-9]+|[A-Za-zА-Яа-я])[.)]\\s[A-Za-zА-Яа-я][.)]\\s')
    union all select doc, ord, kind, n, 'empty_brackets', 1, left(shown, 50) from b where regexp_matches(shown, '\\(\\s*\\)')
    union all select doc, ord, kind, n, 'direct_indent', 1, left(shown, 50) from b where n % 31 = 0 and kind <> 'item'
    union all select doc, -1, 'document', 1, 'centered_lines', count(*) filter (n % 7 = 0 and n % 3 > 0), null from b group by doc)"""


def profile_facts(spark, d):
    n, q, t = F.col("n"), F.col("ord"), F.col("text")
    rows = seg(spark, d).where("text <> ''").select("doc", F.col("seg").alias("ord"), "text", F.length("text").alias("n"))
    kind = F.when(n % 19 == 1, "figure").when(t.contains(" | "), "table").when(n % 13 == 2, "caption").when(F.startswith(t, F.lit("- ")) | (n % 17 == 5), "item").when(n < 46, "heading").otherwise("body")
    k = q.cast("string")
    shown = F.when((n % 13 == 2) & (q % 2 == 0), F.concat(F.lit("Рисунок "), k, F.lit(" "), t)).when(n % 13 == 2, F.concat(F.lit("Таблица "), k, F.lit(" "), t)).when((n % 17 == 5) & (q % 3 == 0), F.concat(k, F.lit(". "), t)).when(n % 53 == 0, F.concat(t, F.lit(" ( )"))).otherwise(t)
    b = rows.select("doc", "ord", "n", kind.alias("kind"), shown.alias("text"))
    fact = lambda name, num=None, text=None, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("fact"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("text")))
    r = F.col("kind")
    own = F.array_compact(F.array(
        fact("font", text=F.when(n % 41 == 3, "Arial").otherwise("Times")),
        fact("size", 10.0 + F.when(n % 37 == 5, 0.5).when(n % 5 == 0, 0.2).otherwise(0.0)),
        fact("bold", text=F.when((r == "heading") != (n % 43 == 7), "yes").otherwise("no")),
        fact("table_width", 400.0 + n % 9 * 4, when=r == "table"),
        fact("item_place", 60.0 + n % 4 * 12 + F.when(n % 23 == 4, 5).otherwise(0), when=r == "item"),
        fact("direct_indent", F.lit(1), F.substring("text", 1, 50), (n % 31 == 0) & (r != "item")),
    ))
    facts = b.select("doc", "ord", F.col("kind").alias("role"), "n", F.explode(F.concat(own, profile.text_facts(r, F.col("text")))).alias("f")).select("doc", "ord", "role", "n", "f.*")
    places = profile.caption_places(b).join(b.select("doc", "ord", "n"), ["doc", "ord"]).select(*facts.columns)
    lines = b.groupBy("doc").agg(F.sum(F.when((n % 7 == 0) & (n % 3 > 0), 1).otherwise(0)).cast("double").alias("num"))
    lines = lines.select("doc", F.lit(-1).alias("ord"), F.lit("document").alias("role"), F.lit(1).alias("n"), F.lit("centered_lines").alias("fact"), "num", F.lit(None).cast("string").alias("text"))
    return facts.unionByName(places).unionByName(lines)


@query(f"""with f as materialized (select * from {_FACTS}),
    u as (select doc, role, fact, num, text from (select *, row_number() over (partition by doc, role, fact order by w desc, num nulls first, text nulls first) as r from (select doc, role, fact, num, text, sum(n) as w from f where fact in ('font', 'size', 'bold', 'table_width') group by 1, 2, 3, 4, 5)) where r = 1),
    i as (select doc, list_sort(list(num)) as near from (select doc, num from f where fact = 'item_place' group by 1, 2 having count(*) >= 2) group by 1),
    c as (select doc, count(*) filter (n % 7 = 0) as need from (select doc, length(text) as n from {SEG} where text <> '') group by 1)
    select f.doc, cast(f.ord as integer) as ord, case f.fact when 'table_width' then 'table_width' else 'style' end as rule, f.fact, coalesce(cast(round(f.num, 2) as varchar), f.text) as was, coalesce(cast(round(u.num, 2) as varchar), u.text) as need
      from f join u using (doc, role, fact) where case when f.fact = 'size' then abs(f.num - u.num) > 0.25 when f.fact = 'table_width' then abs(f.num - u.num) > 0.05 * 300 else f.text <> u.text end
    union all select doc, cast(ord as integer), 'item_place', fact, cast(round(num, 2) as varchar), array_to_string(list_transform(near, lambda x: cast(round(x, 2) as varchar)), ' ') from f join i using (doc) where fact = 'item_place' and len(list_filter(near, lambda x: abs(x - num) <= 2)) = 0
    union all select doc, cast(ord as integer), 'captions', fact, text, case role when 'figure caption' then 'below figure' else 'above table' end from f where fact = 'caption_place' and starts_with(text, 'not ')
    union all select doc, cast(ord as integer), 'centered_lines', fact, cast(round(num, 2) as varchar), cast(round(need :: double, 2) as varchar) from f join c using (doc) where fact = 'centered_lines' and num < need
    union all select doc, cast(ord as integer), case when fact = 'direct_indent' then 'direct' else fact end, fact, text, null from f where fact in ('typed_number', 'empty_brackets', 'direct_indent')""")
def profile_violations(spark, d):
    """Blocks that break a rule of their document's profile."""
    facts = profile_facts(spark, d)
    usual = profile.usual(facts.where(F.col("fact").isin("font", "size", "bold", "table_width")), "n").withColumn("unit", F.lit(300.0))
    unit = F.lit(None).cast("double").alias("unit")
    items = facts.where("fact = 'item_place'").groupBy("doc", "role", "fact", "num").agg(F.count("*").alias("k")).where("k >= 2").select("doc", "role", "fact", "num", F.lit(None).cast("string").alias("text"), unit)
    docs = seg(spark, d).where("text <> ''").groupBy("doc").agg(F.sum(F.when(F.length("text") % 7 == 0, 1).otherwise(0)).cast("double").alias("num"))
    lines = docs.select("doc", F.lit("document").alias("role"), F.lit("centered_lines").alias("fact"), "num", F.lit(None).cast("string").alias("text"), unit)
    place = lambda role, text: docs.select("doc", F.lit(role).alias("role"), F.lit("caption_place").alias("fact"), F.lit(None).cast("double").alias("num"), F.lit(text).alias("text"), unit)
    wanted = usual.unionByName(items).unionByName(lines).unionByName(place("figure caption", "below figure")).unionByName(place("table caption", "above table"))
    return profile.violations(facts, wanted)
