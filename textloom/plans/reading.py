"""Queries over language pairs, memories, stems, page kinds and what is written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import languages as L
from textloom.functions import morphology as M
from textloom.functions import text as X
from textloom.operators import cover, dictionary, ink, memory
from textloom.plans.blocks import _ITEMS, drawn_items
from textloom.plans.documents import _ENT, _HITS, _KEY, _STEM, _WORDS, SEG, STUB, entries, seg, texts
from textloom.plans.layout import BOXES, boxes
from textloom.plans.registry import Registry
from textloom.plans.writing import _CYRILLIC, _LATIN, cyrillic
from textloom.sources import sinks
from textloom.sources.scratch import scratch_path
from textloom.sources.tables import table

query = Registry()

# -- languages

_PAIRS = ("ru-en", " HU - ru ", "", "ru-ru", "de-en", "en-hu", "hu_ru", "en-RU")
_CELLS = ("Magyar", "русский ", " ENGLISH", "Comment", "orosz", "Венгерский")
_PAIR_SQL = "(select doc, seg, text, [" + ", ".join(f"'{x}'" for x in _PAIRS) + f"][(doc + seg) % {len(_PAIRS)} + 1] as pair from {SEG})"
_SRC = "case when pair = '' then 'hu' when ok then a end"
_TGT = "case when pair = '' then 'ru' when ok then b end"
_PARSED = f"(select doc, seg, text, pair, {_SRC} as src, {_TGT} as tgt from (select *, a in ('hu', 'ru', 'en') and b in ('hu', 'ru', 'en') and a <> b as ok from (select *, regexp_extract(lower(pair), '^\\s*([a-z]{{2}})\\s*-\\s*([a-z]{{2}})\\s*$', 1) as a, regexp_extract(lower(pair), '^\\s*([a-z]{{2}})\\s*-\\s*([a-z]{{2}})\\s*$', 2) as b from {_PAIR_SQL})))"


def paired(spark, d):
    pair = F.get(F.array(*map(F.lit, _PAIRS)), ((F.col("doc") + F.col("seg")) % len(_PAIRS)).cast("int"))
    return seg(spark, d).withColumn("pair", pair)


def _header_sql(c: str) -> str:
    return f"case lower(trim({c})) " + " ".join(f"when '{k}' then '{v}'" for k, v in L.HEADER.items()) + " end"


@query(f"""with h as (select *, {_header_sql("c1")} as a, {_header_sql("c2")} as b from (select *, [{", ".join(f"'{x}'" for x in _CELLS)}][seg % {len(_CELLS)} + 1] as c1, [{", ".join(f"'{x}'" for x in _CELLS)}][(seg * 5 + doc) % {len(_CELLS)} + 1] as c2 from {_PARSED}))
    select doc, cast(seg as integer) as seg, src, tgt, '_' || upper(tgt) as suffix, case when a <> b then a end as head_src, case when a <> b then b end as head_tgt from h""")
def language_pairs(spark, d):
    cell = lambda k: F.get(F.array(*map(F.lit, _CELLS)), (k % len(_CELLS)).cast("int"))
    p, h = L.parsed_pair(F.col("pair")), L.header_languages(cell(F.col("seg")), cell(F.col("seg") * 5 + F.col("doc")))
    return paired(spark, d).select("doc", "seg", p["src"].alias("src"), p["tgt"].alias("tgt"), L.file_suffix(F.col("pair")).alias("suffix"), h["src"].alias("head_src"), h["tgt"].alias("head_tgt"))


_LOUD = "len(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '\\p{Lu}{3,}'))) > 0"
_LOWERED = f"case when {_LOUD} then t else array_to_string(list_transform(string_split(t, ' '), lambda w, i: case when regexp_full_match(w, '\\p{{Cyrillic}}{{5,}}') and w = upper(w) then case when i = 1 then upper(w[1]) || lower(w[2:]) else lower(w) end else w end), ' ') end"


def _units_sql(c: str) -> str:
    out = f"regexp_replace({c}, '\\s*\\[(?:уточнить|проверено)[^\\]]*\\]', '', 'g')"
    for unit, target in sorted(X.UNITS, key=lambda u: -len(u[0])):
        out = f"regexp_replace({out}, '([0-9])\\s?{unit}($|[^\\p{{L}}\\p{{N}}_/])', '\\1 {target}\\2', 'g')"
    return out


_DONE = f"case when seg % 2 = 0 then upper(translate(replace(text, 'ß', 's'), '{_LATIN}', '{_CYRILLIC}')) else translate(text, '{_LATIN}', '{_CYRILLIC}') end || ' 5 bar, 7kW [проверено]'"


@query(f"""with p as (select *, {_DONE} as t from {_PARSED})
    select doc, cast(seg as integer) as seg, case when src = 'hu' and tgt = 'ru' then {_units_sql(_LOWERED)} when tgt = 'ru' then {_units_sql("t")} else t end as fixed from p""")
def finished_by_pair(spark, d):
    """Last steps of a target by its pair, on targets half of which are capitals."""
    t = cyrillic(F.col("text"))
    out = F.concat(F.when(F.col("seg") % 2 == 0, F.upper(cyrillic(F.replace("text", F.lit("ß"), F.lit("s"))))).otherwise(t), F.lit(" 5 bar, 7kW [проверено]"))
    return paired(spark, d).select("doc", "seg", L.finished(F.col("pair"), F.col("text"), out).alias("fixed"))


_NOISE = ("........eee.sss12", "", "Fejezet.....ssseegí..34 ", "szükségessége: ", "ssszzzeeeégí. ", "a,,,,iiii.....9 ")


@query()
def leaders_removed(spark, d):
    """Dotted leaders read as letters; no SQL, as its patterns have no look-behind: tests hold it against a plain loop."""
    noise = F.get(F.array(*map(F.lit, _NOISE)), ((F.col("doc") + F.col("seg")) % len(_NOISE)).cast("int"))
    return seg(spark, d).select("doc", "seg", L.without_leaders(F.concat("text", noise)).alias("clean"))


_LEFT = f"(select doc, seg, text || ' BLÜGY' as src, text || case seg % 4 when 0 then ' НСБ (BLÜGY)' when 1 then ' BLÜGY' when 2 then ' érték_x Paksi Atomerőmű' else ' (ÁNEREM)' end as out from {SEG})"


@query(f"""select doc, cast(seg as integer) as seg, list_filter(regexp_extract_all(out, '[A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű_]{{2,}}'), lambda w: regexp_matches(w, '[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]') and (lower(w) = w or upper(w) = w or contains(w, '_')) and not (upper(w) = w and contains(out, '(' || w || ')') and contains(src, w))) as words from {_LEFT}""")
def source_words_left(spark, d):
    k, t = F.col("seg") % 4, F.col("text")
    out = F.concat(t, F.when(k == 0, " НСБ (BLÜGY)").when(k == 1, " BLÜGY").when(k == 2, " érték_x Paksi Atomerőmű").otherwise(" (ÁNEREM)"))
    return seg(spark, d).select("doc", "seg", L.source_words(F.concat(t, F.lit(" BLÜGY")), out).alias("words"))


# -- memories, stems, terms


@query(f"""with r as (select doc, seg, {_KEY} as k, regexp_replace({_KEY}, '[0-9]+', '§', 'g') as tk, text from {SEG}),
    tm as (select k, min('tm ' || doc) as t from r where doc % 3 = 0 and k <> '' group by 1), me as (select k, min('memory ' || doc) as t from r where doc % 2 = 0 and k <> '' group by 1),
    te as (select tk as k, min('template ' || doc) as t from r where contains(tk, '§') group by 1 having count(*) > 1)
    select doc, cast(seg as integer) as seg, coalesce(tm.t, me.t, te.t) as tgt, case when tm.t is not null then 'tm' when me.t is not null then 'memory' when te.t is not null then 'template' else 'none' end as origin from r left join tm using (k) left join me using (k) left join te on te.k = r.tk""")
def memory_lookup(spark, d):
    """The first of three memories that has a segment."""
    rows = seg(spark, d).select(F.struct("doc", "seg").alias("id"), X.tm_key(F.col("text")).alias("k")).withColumn("tk", X.digits_key(F.col("k")))
    told = lambda name, rows_, key: rows_.groupBy(F.col(key).alias("k")).agg(F.min(F.concat(F.lit(f"{name} "), F.col("id.doc").cast("string"))).alias("tgt"), F.count("*").alias("n"))
    tm, own = told("tm", rows.where("id.doc % 3 = 0 and k <> ''"), "k"), told("memory", rows.where("id.doc % 2 = 0 and k <> ''"), "k")
    templates = told("template", rows.where(F.contains("tk", F.lit("§"))), "tk").where("n > 1")
    return memory.looked_up(rows, tm, own, templates).select("id.doc", "id.seg", "tgt", "origin")


@query(f"""with e as (select entry, list_distinct({_WORDS.format("term")}) as ws from {_ENT}), w as (select entry, len(ws) as n, unnest(ws) as tw from e where len(ws) >= 3),
    t as (select doc_id as id, {_WORDS.format("text")} as w from documents where text is not null), p as (select id, unnest(range(len(w))) as i, unnest(w) as w from t),
    h as (select p.id, w.entry, w.n, w.tw, p.i from p join w on {_STEM.format("p.w")} = {_STEM.format("w.tw")}),
    s as (select a.id, a.entry, a.n, a.i, count(distinct b.tw) as got from (select distinct id, entry, n, i from h) as a join h as b on a.id = b.id and a.entry = b.entry and b.i between a.i and a.i + a.n + 1 group by 1, 2, 3, 4)
    select distinct id, entry from s where got = n""")
def terms_in_windows(spark, d):
    """Entries of three words or more, all of them within a window, in any order."""
    return dictionary.window_hits(texts(spark, d), entries(spark))


@query(_HITS + f""", found as (select distinct id, entry from h),
    a as (select distinct doc_id as id, unnest(regexp_extract_all(' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' ', ' ([A-Z]{{2,6}}) ', 1)) as a from documents),
    n as (select entry, unnest(regexp_extract_all(term, '\\(([A-Z]{{2,6}})\\)', 1)) as a from {_ENT}),
    more as (select id, entry, row_number() over (partition by id order by entry) as r from (select distinct id, entry from a join n using (a) where (id, entry) not in (select id, entry from found)))
    select id, entry, 'main' as kind from found union all select id, entry, 'second' from more where r <= 6""")
def term_hits_with_second(spark, d):
    """Entries found by their words, and up to six more found by their abbreviation in brackets."""
    found = dictionary.phrase_hits(texts(spark, d), entries(spark)).select("id", "entry").distinct()
    more = dictionary.paren_abbreviations(texts(spark, d), entries(spark), found).where("rank <= 6").select("id", "entry")
    return found.withColumn("kind", F.lit("main")).unionByName(more.withColumn("kind", F.lit("second")))


_ENDINGS = "|".join(sorted(M.RU_ENDINGS, key=lambda p: (-len(p), p)))
_SUFFIXES = "|".join(sorted(M.MINED_SUFFIXES, key=lambda p: (-len(p), p)))


@query(f"""with w as (select distinct unnest(regexp_extract_all(case when doc_id % 2 = 0 then translate(text, '{_LATIN}', '{_CYRILLIC}') else text end, '\\p{{L}}+')) as w from documents)
    select w, case when regexp_matches(lower(w), '^[а-яё]') then regexp_replace(replace(lower(w), 'ё', 'е'), '^(.{{3,}}?)({_ENDINGS})$', '\\1') when length(w) >= 5 then regexp_replace(lower(w), '[ae]$', '') else lower(w) end as stem,
      regexp_replace(regexp_replace(w, '^(.{{4,}}?)({_SUFFIXES})$', '\\1'), '^(.{{4,}}?)({_SUFFIXES})$', '\\1') as mined from w""")
def word_stems(spark, d):
    """Stems of every different word, Latin and Cyrillic."""
    t = F.when(F.col("doc_id") % 2 == 0, cyrillic(F.col("text"))).otherwise(F.col("text"))
    words = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0))).alias("w")).distinct()
    return words.select("w", M.stem(F.col("w")).alias("stem"), M.mined_stem(F.col("w")).alias("mined"))


@query(f"""select doc, cast(seg as integer) as seg, list_transform(list_sort(list_transform(map_entries(m), lambda e: {{'i': e.value, 'w': e.key}})), lambda x: x.w) as words
    from (select doc, seg, map_from_entries(list_transform(list_distinct(w), lambda x: {{'k': x, 'v': list_position(w, x)}})) as m from (select doc, seg, list_filter(string_split(text, ' '), lambda x: x <> '') as w from {SEG}))""")
def words_once_in_order(spark, d):
    return seg(spark, d).select("doc", "seg", F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")).alias("words"))


# -- kinds of pages


@query(f"""with i as materialized (select * from {_ITEMS}), p as (select page, max(page_area) as area, coalesce(sum((x1 - x0) * (y1 - y0)) filter (kind = 'image'), 0) as images, count(*) filter (kind = 'unseen') * 2 > count(*) filter (kind <> 'image') as read_ from i group by 1),
    k as (select page, page // 5 as doc, images >= 0.5 * area as scan, page % 3 > 0 as ocr from p)
    select doc, count(*) as pages, count(*) filter (ocr) as ocr, count(*) filter (ocr and scan) as scans, count(*) filter (ocr) > 0 and 2 * count(*) filter (ocr) >= count(*) and 2 * count(*) filter (ocr and scan) < count(*) filter (ocr) as suits from k group by 1""")
def built_from_segments(spark, d):
    """Documents that are put together from their recognised segments: half of the pages or more are recognised, and under half of those are scans."""
    pages = cover.page_kinds(drawn_items(spark, d)).withColumns({"doc": F.floor(F.col("page") / 5), "ocr": F.col("page") % 3 > 0})
    return cover.suits_segments(pages)


# -- what is written out


@query(f"""with w as (select doc, w, count(*) as n from (select doc, unnest(regexp_extract_all(text, '\\p{{L}}{{6,}}')) as w from {SEG}) group by 1, 2 having count(*) >= 3)
    select doc, cast(row_number() over (partition by doc order by n desc, w) as integer) as ord, '| ' || w || ' | ' || {STUB.replace("text", "w")} || ' | auto' || case when n >= 5 then '' else ', UNSURE' end || '; occurs ' || n || ' times |' as line from w""")
def mined_term_lines(spark, d):
    words = seg(spark, d).select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), 0)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n")).where("n >= 3")
    return sinks.term_lines(words.select("doc", "term", X.stand_in(F.col("term")).alias("target"), (F.col("n") >= 5).alias("sure"), "n"))


_EDITED = f"(select doc, seg, seg // 12 + 1 as page, text as source, text || '  .' as was, replace(text, ' ', ' ') as now, case seg % 3 when 0 then ['space'] when 1 then ['space', 'unit'] else [] end as rules from {SEG} where text <> '')"


@query(f"select doc, cast(seg as integer) as seg, cast(page as varchar) as page, unnest(rules) as rule, cast(generate_subscripts(rules, 1) as integer) as pass, was, now, source from {_EDITED} where was <> now")
def edit_journal(spark, d):
    k, t = F.col("seg") % 3, F.col("text")
    rules = F.when(k == 0, F.array(F.lit("space"))).when(k == 1, F.array(F.lit("space"), F.lit("unit"))).otherwise(F.array().cast("array<string>"))
    rows = seg(spark, d).where("text <> ''").select("doc", "seg", (F.floor(F.col("seg") / 12) + 1).alias("page"), t.alias("source"), F.concat(t, F.lit("  .")).alias("was"), t.alias("now"), rules.alias("rules"))
    return sinks.edit_journal(rows)


@query(f"""select doc, cast(seg as integer) as seg, cast(seg // 12 + 1 as varchar) as page, rule, case split_part(rule, '/', 1) when 'quotes' then 'Quotation marks' when 'noise' then 'Noise' else '' end || ': ' || why as why, text
    from (select doc, seg, text, unnest(list_filter([case when contains(text, '"') then 'quotes/straight' end, case when regexp_matches(text, '[*#%&$]{{3}}') then 'noise' end, case when ends_with(text, ' ') then 'space' end], lambda x: x is not null)) as rule, '' || length(text) as why from {SEG})""")
def remaining_violations(spark, d):
    t = F.col("text")
    rules = F.array_compact(F.array(F.when(F.contains(t, F.lit('"')), "quotes/straight"), F.when(t.rlike("[*#%&$]{3}"), "noise"), F.when(F.endswith(t, F.lit(" ")), "space")))
    rows = seg(spark, d).select("doc", "seg", (F.floor(F.col("seg") / 12) + 1).alias("page"), F.explode(rules).alias("rule"), F.length(t).cast("string").alias("why"), "text")
    return sinks.remaining_violations(rows, {"quotes": "Quotation marks", "noise": "Noise"})


@query(f"select cast(doc % 40 as integer) as doc, source_doc, cast(seg as integer) as seg, case when doc % 40 % 5 = 0 then 'new ' || text else text end as text from (select doc, doc as source_doc, seg, text from {SEG}) where not (doc % 40 % 5 = 0 and seg % 2 = 1)")
def states_overwritten(spark, d):
    """States are stored by document; those of every fifth one are replaced by new ones with fewer rows, the others stay."""
    rows = seg(spark, d).select((F.col("doc") % 40).cast("int").alias("doc"), F.col("doc").alias("source_doc"), "seg", "text")
    path = scratch_path(spark, "states")
    sinks.overwrite_documents(rows, path)
    sinks.overwrite_documents(rows.where("doc % 5 = 0 and seg % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")), path)
    return spark.read.schema(rows.schema).parquet(path).select("doc", "source_doc", "seg", "text")


# -- recognised words (confidence, ink and height follow the place and length of every word; some are glued to labels, some are boxes)

_READ = f"""(select page, line, id, case when id % 41 = 7 then left(t, 2) || 'Név:' when id % 43 = 5 then '|Dátum:' when id % 37 = 3 then '[l' when id % 47 = 2 then 'e' else t end as t, x0, y0, case when id % 37 = 3 then x0 + 10 else x1 end as x1, y1,
    case when id % 47 = 2 then 5.0 when id % 29 = 1 then 18.0 when id % 53 = 4 then 1.0 else 9.0 + length(t) % 3 end as h, (id * 37 + length(t) * 11) % 101 as conf, (id * 13 + length(t) * 7) % 60 / 100.0 as ink, id % 3 > 0 as confirmed from {BOXES})"""
_HU_SMALL, _HU_BIG = "a-záéíóöőúüű", "A-ZÁÉÍÓÖŐÚÜŰ"


def read_words(spark, d):
    k, n = F.col("id"), F.length("t")
    t = F.when(k % 41 == 7, F.concat(F.left("t", F.lit(2)), F.lit("Név:"))).when(k % 43 == 5, "|Dátum:").when(k % 37 == 3, "[l").when(k % 47 == 2, "e").otherwise(F.col("t"))
    h = F.when(k % 47 == 2, 5.0).when(k % 29 == 1, 18.0).when(k % 53 == 4, 1.0).otherwise(9.0 + n % 3)
    x1 = F.when(k % 37 == 3, F.col("x0") + 10).otherwise(F.col("x1"))
    return boxes(spark, d).select("page", "line", "id", t.alias("t"), "x0", "y0", x1.alias("x1"), "y1", h.alias("h"), ((k * 37 + n * 11) % 101).alias("conf"), ((k * 13 + n * 7) % 60 / 100.0).alias("ink"), (k % 3 > 0).alias("confirmed"))


@query(f"""with r as (select *, regexp_extract(t, '^(.+?)([{_HU_BIG}][{_HU_SMALL}]{{2,}}:)$', 1) as a, regexp_extract(t, '^(.+?)([{_HU_BIG}][{_HU_SMALL}]{{2,}}:)$', 2) as b from {_READ}),
    s as (select *, x0 + (x1 - x0) * length(a) / length(t) as cut, b <> '' and not regexp_matches(a, '[{_HU_BIG}]{{2}}') as glued from r),
    w as (select page, line, id, 0 as part, t, x0, x1, y0, y1, h, conf, ink, confirmed from s where not glued union all select page, line, id, 1, a, x0, cut, y0, y1, h, conf, ink, confirmed from s where glued and not regexp_full_match(a, '[|Il1\\[\\]]')
      union all select page, line, id, 2, b, cut, x1, y0, y1, h, conf, ink, confirmed from s where glued),
    m as (select *, list_sort(list(h) over (partition by page, line)) as hs from w where h >= 2),
    u as (select *, hs[(len(hs) - 1) // 2 + 1] as usual from m),
    k as materialized (select *, (ink < 0.05 or conf < 80 and ink < 0.08 or conf < 60 and len(hs) >= 2 and h > 1.6 * usual or conf < 30 and not confirmed) and not regexp_matches(t, '^[A-Za-z{_HU_SMALL[3:]}{_HU_BIG[3:]}]{{3,}}:') as hand from u
      where not (length(t) <= 3 and conf < 60 and (x1 - x0) / greatest(y1 - y0, 0.1) between 0.75 and 1.3 and (h >= 1.15 * usual or regexp_matches(t, '[\\[\\]£|]'))) and not (length(t) = 1 and h < 0.7 * usual and ink > 0.55)),
    z as (select page, x0, x1, y0, y1, unnest(range(cast(line as bigint) - 1, cast(line as bigint) + 2)) as near from k where hand and length(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2)
    select page, cast(id as integer) as id, part, t from k where not hand and regexp_matches(t, '[\\p{{L}}\\p{{N}}_<>≤≥=±÷+%°Δ×→]') and not regexp_matches(t, '^\\[?[LlI1|]{{0,2}}\\]$|^\\[$')
      and not (conf < 90 and ink < 0.08 and not regexp_matches(t, '^[A-Za-z{_HU_SMALL[3:]}{_HU_BIG[3:]}]{{3,}}:') and exists (select 1 from z where z.page = k.page and z.near = k.line and k.x0 < z.x1 + 3 and k.x1 > z.x0 - 3 and k.y0 < z.y1 + 3 and k.y1 > z.y0 - 3))""")
def printed_words(spark, d):
    """Printed words among recognised ones of whole pages."""
    return ink.printed(ink.unglued(read_words(spark, d)).withColumn("raw", F.col("t")))
