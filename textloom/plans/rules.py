"""Queries over terms, answers, alignments, conventions and page rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import answers as A
from textloom.functions import conventions as V
from textloom.functions import morphology as M
from textloom.functions import terms as T
from textloom.functions import text as X
from textloom.operators import align, audit, dictionary, order, quality
from textloom.plans.documents import _ENT, _HITS, _NESTED, SEG, STUB, entries, seg, texts
from textloom.plans.registry import Registry
from textloom.sources.tables import table

query = Registry()

# -- terms

TERMS = """(select p_partkey as id, case p_partkey % 7 when 0 then p_name || ' (' || p_brand || ')' when 1 then split_part(p_name, ' ', 1) || ' / ' || p_type || ' ' || split_part(p_name, ' ', 2) when 2 then p_name || ' … ' || p_type
    when 3 then 'nem ' || p_name || ' / ' || p_name when 4 then '(' || p_type || ')' when 5 then p_name || ' / ' || p_brand || ' / a' else p_name end as term,
    case when p_partkey % 2 = 1 then p_type || ' / ' || p_name else p_type || ' (' || p_brand || ')' end as tgt, case p_partkey % 5 when 0 then 'строгий; ' || p_brand when 1 then p_type || '; проверено; [уточнить]' when 2 then '' end as note from part)"""


def terms(spark, d):
    k, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    made = [F.concat(name, F.lit(" ("), brand, F.lit(")")), F.concat(first, F.lit(" / "), kind, F.lit(" "), second), F.concat(name, F.lit(" … "), kind), F.concat(F.lit("nem "), name, F.lit(" / "), name), F.concat(F.lit("("), kind, F.lit(")")), F.concat(name, F.lit(" / "), brand, F.lit(" / a"))]
    term = name
    for n, x in enumerate(made):
        term = F.when(k % 7 == n, x).otherwise(term)
    note = F.when(k % 5 == 0, F.concat(F.lit("строгий; "), brand)).when(k % 5 == 1, F.concat(kind, F.lit("; проверено; [уточнить]"))).when(k % 5 == 2, "")
    tgt = F.when(k % 2 == 1, F.concat(kind, F.lit(" / "), name)).otherwise(F.concat(kind, F.lit(" ("), brand, F.lit(")")))
    return table(spark, d, "part").select(k.alias("id"), term.alias("term"), tgt.alias("tgt"), note.alias("note"))


_TW = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"


@query(f"""with a as (select id, tgt, case when regexp_matches(regexp_replace(term, '\\([^)]*\\)', ' ', 'g'), '[\\p{{L}}\\p{{N}}]') then regexp_replace(term, '\\([^)]*\\)', ' ', 'g') else translate(term, '()', '  ') end as core from {TERMS}),
    b as (select id, tgt, string_split_regex(core, '\\s+/\\s+') as parts from a), c as (select *, {_TW.format("parts[1]")} as w1, {_TW.format("coalesce(parts[2], '')")} as w2 from b),
    e as (select id, k, case when k = 1 and len(parts) >= 2 and contains(regexp_replace(tgt, '\\([^)]*\\)', ' ', 'g'), '/') and len(w1) = 1 and len(w2) >= 2 and lower(w1[1]) <> lower(w2[1]) then w1 || w2[2:] else {_TW.format("parts[k]")} end as words,
      regexp_matches(parts[k], '…|\\.\\.\\.') as gap from (select *, unnest(range(1, len(parts) + 1)) as k from c)),
    f as (select * from e where len(words) > 0 and not (len(words) = 1 and length(words[1]) < 3 and not regexp_full_match(words[1], '\\p{{Lu}}{{2,}}')))
    select id, cast(row_number() over (partition by id order by k) - 1 as integer) as k, array_to_string(words, ' ') as words, gap and len(words) > 1 as gapped from f x
    where not exists (select 1 from f y where y.id = x.id and lower(array_to_string(y.words, ' ')) = 'nem ' || lower(array_to_string(x.words, ' ')))""")
def term_variants(spark, d):
    found = terms(spark, d).select("id", F.posexplode(T.variants(F.col("term"), F.col("tgt"))).alias("k", "v"))
    return found.select("id", "k", F.array_join("v.words", " ").alias("words"), F.col("v.gapped").alias("gapped"))


@query(f"""with a as (select *, trim(regexp_replace(tgt, '\\s*\\([^)]*\\)', '', 'g')) as bare, array_to_string(regexp_extract_all(tgt, '\\(([^)]*)\\)', 1), ', ') as also,
      left(regexp_replace(regexp_replace(replace(replace(replace(coalesce(note, ''), 'строгий', ''), 'проверено', ''), '[уточнить]', ''), '(;\\s*){{2,}}', '; ', 'g'), '^[;\\s]+|[;\\s]+$', '', 'g'), 110) as own from {TERMS})
    select id, '- ' || term || ' → ' || bare || case when also <> '' and own <> '' then '  [also: ' || also || '; ' || own || ']' when also <> '' then '  [also: ' || also || ']' when own <> '' then '  [' || own || ']' else '' end as line from a""")
def term_lines(spark, d):
    return terms(spark, d).select("id", T.term_line(F.col("term"), F.col("tgt"), F.col("note")).alias("line"))


@query(_HITS + _NESTED + f""", s as (select entry, tgt, list_transform(list_filter(regexp_extract_all(lower(tgt), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4), lambda w: substring(w, 1, greatest(3, least(5, length(w) - 2)))) as stems from {_ENT} where entry % 2 = 1),
    m as (select f.id, f.entry, s.tgt from free f join s using (entry) join documents d on d.doc_id = f.id where len(list_filter(stems, lambda x: not contains(lower(translate(d.text, 'aeiouAEIOU', 'eiouaEIOUA')), x))) > 0)
    select id, list(entry order by entry)[1:3] as missing from m group by id""")
def mandatory_terms(spark, d):
    """The first three entries of the strict part that a target lacks; nesting is told by all entries."""
    hits = dictionary.phrase_hits(texts(spark, d), entries(spark))
    strict = entries(spark).where("entry % 2 = 1")
    targets = texts(spark, d).select("id", X.stand_in(F.col("text")).alias("out"))
    return dictionary.missing_targets(hits, strict, targets).groupBy("id").agg(F.slice(F.array_sort(F.collect_set("entry")), 1, 3).alias("missing"))


@query(_HITS + """, b as (select distinct id, entry, case when entry in (1, 4, 9) then 0 when entry % 2 = 1 then 1 else 2 end as layer, j - i as n from h), m as (select id, entry, layer, max(n) as n from b group by 1, 2, 3)
    select id, entry, cast(row_number() over (partition by id order by layer, n desc, entry) as integer) as rank from m qualify rank <= 4""")
def term_context(spark, d):
    """Entries of a text for a request: the main layer first, then strict ones, then hints, longer first; the first four (the request's size here)."""
    hits = dictionary.phrase_hits(texts(spark, d), entries(spark))
    layer = F.when(F.col("entry").isin(1, 4, 9), 0).when(F.col("entry") % 2 == 1, 1).otherwise(2)
    return dictionary.by_layer(hits.withColumn("layer", layer), 4)


# -- answers


def _answer(spark, d):
    """Answers of 25 segments each, in JSON; every fourth object has its text as it is, with quotes more; every third answer is torn."""
    rows = seg(spark, d).select("doc", F.floor(F.col("seg") / 25).alias("pack"), (F.col("seg") % 25).alias("n"), F.col("text").alias("t"), F.coalesce("lang", F.lit("")).alias("lang"))
    raw = F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit(', "t": "'), F.col("t"), F.lit(' "x" ", "lang": "'), F.col("lang"), F.lit('"}'))
    one = F.when(F.col("n") % 4 == 3, raw).otherwise(F.to_json(F.struct("n", "t", "lang")))
    whole = rows.groupBy("doc", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("o")))), lambda x: x["o"]), ", ").alias("a"))
    return whole.select("doc", "pack", F.when(F.col("pack") % 3 == 2, F.expr("left(a, length(a) - 3)")).otherwise(F.concat(F.lit("Here: ["), F.col("a"), F.lit("] done"))).alias("a"))


@query(f"""with r as (select doc, seg // 25 as pack, seg % 25 as n, text as t, coalesce(lang, '') as lang, max(seg % 25) over (partition by doc, seg // 25) as last from {SEG})
    select doc, cast(pack as bigint) as pack, cast(n as integer) as n, t || case when n % 4 = 3 then ' "x" ' else '' end as t, lang from r where not (pack % 3 = 2 and n = last)""")
def answer_rows(spark, d):
    """Objects read back from answers, whatever their texts hold."""
    return _answer(spark, d).select("doc", "pack", F.explode(A.answer_objects(F.col("a"))).alias("o")).select("doc", "pack", "o.*")


@query(f"select doc, cast(seg as bigint) as n, text as t from {SEG}")
def batch_round_trip(spark, d):
    rows = seg(spark, d).select("doc", F.col("seg").cast("long").alias("n"), F.col("text").alias("t"))
    return A.answered(A.requests(rows, "doc", F.floor(F.col("n") / 25), "t"), "doc", "t: string")


# -- alignments


@query(f"""with recursive w as (select doc_id as doc, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null), n as (select doc, w, (len(w) + 39) // 40 as n from w where len(w) > 0),
    a as materialized (select doc, k as page, n, list_distinct(w[k * 40 + 1 : k * 40 + 40]) as s from (select *, unnest(range(n)) as k from n)), o as materialized (select doc, n + 1 as m, unnest(range(n + 1)) as page, w from n),
    b as materialized (select doc, page, m, case when page = 0 then ['front'] else list_distinct(w[greatest((page - 1) * 40 - (page % 5) * 3, 0) + 1 : page * 40 - (page % 3) * 9]) end as s from o),
    r as (select doc, cast(-1 as bigint) as page, cast(0 as bigint) as other from (select distinct doc from a) union all
      select doc, page, case when len(any_value(s)) < 5 then any_value(was) when max_by(shared, (score, -k)) >= 0.2 * len(any_value(s)) then max_by(k, (score, -k)) else any_value(was) end as other
      from (select r.doc, a.page, r.other as was, a.s, b.page as k, len(list_intersect(a.s, b.s)) as shared, len(list_intersect(a.s, b.s)) / len(a.s) - 0.04 * abs(b.page - case when a.page = 0 then 0 else least(r.other + 1, b.m - 1) end) as score
        from r join a on a.doc = r.doc and a.page = r.page + 1 join b on b.doc = r.doc and b.page between r.other - 1 and r.other + 7) group by doc, page)
    select doc, cast(page as integer) as page, cast(other as integer) as other from r where page >= 0""")
def matched_pages(spark, d):
    """Pages of 40 words of each document against a build with a front page whose pages begin and end elsewhere."""
    w = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0).alias("w")).where("size(w) > 0")
    n = F.ceil(F.size("w") / 40).cast("int")
    own = w.select("doc", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), n - 1)).alias("page"), "w").select("doc", "side", "page", F.slice("w", F.col("page") * 40 + 1, 40).alias("words"))
    begin = F.greatest((F.col("page") - 1) * 40 - (F.col("page") % 5) * 3, F.lit(0))
    end = F.col("page") * 40 - (F.col("page") % 3) * 9
    built = w.select("doc", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n)).alias("page"), "w")
    built = built.select("doc", "side", "page", F.when(F.col("page") == 0, F.array(F.lit("front"))).otherwise(F.slice("w", begin + 1, F.greatest(end - begin, F.lit(0)))).alias("words"))
    return align.matched_pages(own.unionByName(built))


@query()
def realigned_answers(spark, d):
    """Turns of conversations as labels; answers are the turns, moved on by one in every third conversation, some with look-alike letters."""
    labels = table(spark, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("pic"), (F.col("turn") + 1).cast("int").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    n = F.when(F.col("pic") % 3 == 0, F.col("n") + 1).otherwise(F.col("n"))
    return align.realigned(labels, labels.select("pic", n.alias("n"), F.when(F.col("n") % 2 == 0, F.translate("t", "aeo", "аео")).otherwise(F.col("t")).alias("t")))


@query()
def merged_readings(spark, d):
    """Two readings of each line: the second loses capitals and short words and has other marks."""
    rows = seg(spark, d).where("text <> ''")
    first = F.split("text", " ")
    second = F.filter(F.split(F.translate("text", ".O", ",0"), " "), lambda w: F.length(w) != 2)
    return rows.select("doc", "seg", F.array_join(align.merged_readings(first, second), " ").alias("merged"))


# -- conventions

_PLANTED = f"(select doc, seg, case (doc + seg) % 3 when 0 then '„' || text || '”' when 1 then '«' || text || ' „x y” ' || text || '» „z”' else text end as t from {SEG})"


@query(f"""with p as (select doc, seg, t, unnest(range(1, len(string_split_regex(t, '„[^„“”"«»\\n]+[“”"]')) + 1)) as k, string_split_regex(t, '„[^„“”"«»\\n]+[“”"]') as pieces, regexp_extract_all(t, '„[^„“”"«»\\n]+[“”"]') as quotes from {_PLANTED}),
    o as (select doc, seg, k, pieces[k] as p, quotes[k] as q, sum(length(pieces[k]) - length(replace(pieces[k], '«', '')) - length(pieces[k]) + length(replace(pieces[k], '»', ''))) over (partition by doc, seg order by k) as depth from p)
    select doc, cast(seg as integer) as seg, string_agg(p || case when q is null then '' when depth > 0 then q else '«' || q[2:-2] || '»' end, '' order by k) as fixed from o group by doc, seg""")
def nested_quotes(spark, d):
    """Planted quotes, some inside guillemets."""
    k, t = (F.col("doc") + F.col("seg")) % 3, F.col("text")
    planted = F.when(k == 0, F.concat(F.lit("„"), t, F.lit("”"))).when(k == 1, F.concat(F.lit("«"), t, F.lit(" „x y” "), t, F.lit("» „z”"))).otherwise(t)
    return seg(spark, d).select("doc", "seg", V.nested_quotes(planted).alias("fixed"))


RULES = V.Rules(("UTS",), {"SZBV": "СУЗ"}, ("FIGYELEM", "ВНИМАНИЕ!"), (("próba", "испытани[ея]", "опробование", "gyári próba"),))
_HEADS = ("FIGYELEM! UTS and UTS ", "próba SZBV ", "gyári próba a/b_#.txt és c.cfg: ", "UTS conf/uts.cfg ", " figyelem uts.cfg UTS_1 Uts ", "")
_TAILS = ("ВНИМАНИЕ: UTS ", "испытание SZBV ", "испытания a/b_#.txt ", " ВНИМАНИЕ! uts UTS ", "СУЗ испытания SZBV c.cfg ", "conf/uts.cfg ", "")


def _piece_sql(pieces, k):
    return "replace([" + ", ".join(f"'{x}'" for x in pieces) + f"][({k}) % {len(pieces)} + 1], '#', '' || seg)"


def _piece(pieces, k):
    return F.replace(F.get(F.array(*map(F.lit, pieces)), (k % len(pieces)).cast("int")), F.lit("#"), F.col("seg").cast("string"))


_PATH = "[\\p{L}\\p{N}_.\\-]*[/\\\\_][\\p{L}\\p{N}_./\\\\\\-]*"
_FILE = "([\\p{L}\\p{N}_\\-]+\\.[a-z]{2,4})($|[^\\p{L}\\p{N}_])"


def _named(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '{_PATH}', ' ', 'g'), '{_FILE}', ' \\2', 'g')"
    return f"len(list_filter(regexp_extract_all({bare}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) = 'uts'))"


_ALONE = "list_contains(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), 'SZBV')"


@query(f"""with p as (select doc, seg, {_piece_sql(_HEADS, "doc + seg * 2")} || text as src, {_piece_sql(_TAILS, "seg * 3 + length(text)")} || case when (doc + seg) % 2 = 0 then text else {STUB} end as out from {SEG}),
    c as (select *, list_distinct(list_concat(regexp_extract_all(src, '{_PATH}'), regexp_extract_all(regexp_replace(src, '{_PATH}', ' ', 'g'), '{_FILE}', 1))) as codes from p),
    r as (select doc, seg, list_concat(list_filter([case when {_named("src")} > 0 and {_named("out")} < {_named("src")} then 'name: UTS' end,
      case when {_ALONE.format("src")} and {_ALONE.format("out")} and not contains(out, 'СУЗ') then 'abbreviation: SZBV → СУЗ' end, case when regexp_matches(src, '(?i)^\\s*FIGYELEM') and not starts_with(ltrim(out), 'ВНИМАНИЕ!') then 'warning: ВНИМАНИЕ!' end,
      case when regexp_matches(out, 'испытани[ея]') and contains(src, 'próba') and not contains(src, 'gyári próba') then 'term: ' || regexp_extract(out, 'испытани[ея]') || ' → опробование' end], lambda x: x is not null),
      list_transform(list_filter(codes, lambda x: not contains(out, x)), lambda x: 'code: ' || x)) as rules from c)
    select doc, cast(seg as integer) as seg, unnest(rules) as rule from r""")
def convention_breaks(spark, d):
    """Pairs of whole segments with pieces that keep or break names, abbreviations, warnings, codes and terms with an exception."""
    q, t = F.col("seg"), F.col("text")
    src = F.concat(_piece(_HEADS, F.col("doc") + q * 2), t)
    out = F.concat(_piece(_TAILS, q * 3 + F.length(t)), F.when((F.col("doc") + q) % 2 == 0, t).otherwise(X.stand_in(t)))
    return seg(spark, d).select("doc", "seg", F.explode(V.broken(src, out, RULES)).alias("rule"))


_BARE = "list_transform(list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '^[:;,()«»]+|[:;,()«»]+$', '', 'g')))"


@query(f"""select doc, cast(seg as integer) as seg, len(list_filter(ws, lambda w: not (w = '' or list_contains(have, w) or (ends_with(w, '.') and length(w) >= 4 and len(list_filter(have, lambda x: starts_with(x, left(w, length(w) - 1)))) > 0)))) = 0 as ok,
    cast(greatest(8, floor(length(text) * greatest(pow(0.7 / 0.75, 2), 0.6))) as integer) as most
    from (select doc, seg, text, {_BARE.format("short")} as ws, {_BARE.format("text")} as have from (select *, case (doc + seg) % 3 when 0 then left(text, 5) || '.' when 1 then left(text, 40) else text end as short from {SEG} where trim(text) <> ''))""")
def shortenings(spark, d):
    k, t = (F.col("doc") + F.col("seg")) % 3, F.col("text")
    short = F.when(k == 0, F.concat(F.left(t, F.lit(5)), F.lit("."))).when(k == 1, F.left(t, F.lit(40))).otherwise(t)
    return seg(spark, d).where("trim(text) <> ''").select("doc", "seg", T.shortened(short, t, F.lit("\x00")).alias("ok"), T.shortened_length(F.lit(0.7), t).alias("most"))


# -- pages and streams


@query(f"""with r as (select doc, seg, seg // 12 as page, text from {SEG} where text <> ''), m as (select *, case when lag(page) over w = page - 1 and not regexp_matches(lag(text) over w, '[.!?:;]\\s*$') and regexp_matches(text, '^[\\p{{Ll}}]') then 0 else 1 end as new from r window w as (partition by doc order by seg)),
    i as (select *, sum(new) over (partition by doc order by seg rows unbounded preceding) as island from m) select doc, min(seg) as seg, count(*) as n, string_agg(text, ' ' order by seg) as text from i group by doc, island""")
def rows_over_pages(spark, d):
    """A row that goes on over a page's end is joined with its beginning."""
    rows = seg(spark, d).where("text <> ''").withColumn("page", F.floor(F.col("seg") / 12))
    return order.joined_over_pages(rows, "doc", "seg", "page", "text")


@query(f"select doc, cast(seg as integer) as seg, cast(coalesce(sum(case when regexp_matches(text, '[.]$') then 1 else 0 end) over (partition by doc order by seg rows between unbounded preceding and 1 preceding), 0) + 1 as integer) as page from {SEG}")
def page_numbers(spark, d):
    """The page of a paragraph: one more than the page ends before it."""
    return order.page_numbers(seg(spark, d), "doc", "seg", F.endswith("text", F.lit("."))).select("doc", "seg", "page")


@query(f"select doc, pack, cast(row_number() over (order by size desc, doc, pack) as bigint) as rank, size from (select doc, cast(seg // 50 as bigint) as pack, sum(length(text)) as size from {SEG} group by 1, 2)")
def streams_longest_first(spark, d):
    """Packs of segments in the order in which they are started: the longest first."""
    from textloom.operators.state import numbered

    packs = seg(spark, d).groupBy("doc", F.floor(F.col("seg") / 50).alias("pack")).agg(F.sum(F.length("text")).alias("size")).withColumn("less", -F.col("size"))
    return numbered(packs, ["less", "doc", "pack"], "rank").select("doc", "pack", "rank", "size")


@query(f"""select doc, kind, o, cast(row_number() over (partition by doc order by page, kind, o) as integer) as place from (select doc, 0 as kind, seg as o, seg // 12 as page from {SEG} union all select doc, 1, seg, seg // 12 from {SEG} where seg % 5 = 0)""")
def streams_merged(spark, d):
    """Segments and labels of pictures by page, the labels of a page behind its segments."""
    rows = seg(spark, d).select("doc", F.col("seg").alias("o"), F.floor(F.col("seg") / 12).alias("page"))
    both = rows.withColumn("kind", F.lit(0)).unionByName(rows.where("o % 5 = 0").withColumn("kind", F.lit(1)))
    return both.select("doc", "kind", "o", F.row_number().over(Window.partitionBy("doc").orderBy("page", "kind", "o")).alias("place"))


@query(f"with n as (select count(distinct doc) as n from {SEG}) select md5(text) as image, count(distinct doc) as pages from {SEG}, n where text <> '' group by 1, n having count(distinct doc) <= greatest(1, 0.3 * n) and count(*) > 1")
def image_repeats(spark, d):
    """Pictures (here the digests of lines) that repeat but stand on no more than three tenths of the pages."""
    rows = seg(spark, d).select(F.md5("text").alias("image"), F.col("doc").alias("page"), "text")
    return quality.seldom(rows.where("text <> ''").select("image", "page"), rows.select("page"), 0.3)


@query("select l_suppkey as t, l_linenumber as k, max_by(l_returnflag, (w, -ascii(l_returnflag))) as align, sum(w) as votes from (select l_suppkey, l_linenumber, l_returnflag, sum(l_quantity) as w from lineitem group by 1, 2, 3) group by 1, 2")
def column_votes(spark, d):
    """The alignment of a table's column by weighted votes of its cells."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("t"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("align"), F.col("l_quantity").alias("w"))
    return quality.voted(rows, ["t", "k"], "align", "w")


@query(f"""select source, count(*) as n, cast(sum(lost) as bigint) as lost, cast(sum(residual) as bigint) as residual, cast(sum(tiny) as bigint) as tiny, cast(sum(empty) as bigint) as empty, list_filter([case when sum(lost) > 0.03 * count(*) then 'lost' end, case when sum(residual) > 0.03 * count(*) then 'residual' end, case when sum(tiny) > 0.02 * count(*) then 'tiny' end, case when sum(empty) > 0 then 'empty' end], lambda x: x is not null) as flags
    from (select source, case when (doc + seg) % 29 = 0 then 1 else 0 end as lost, case when regexp_matches(out, '[À-ÿ]') then 1 else 0 end as residual, case when length(out) between 1 and 3 then 1 else 0 end as tiny, case when out = '' then 1 else 0 end as empty
      from (select source, doc, seg, case when (doc + seg) % 29 = 0 then '' else {STUB} end as out from {SEG})) group by source""")
def corpus_metrics(spark, d):
    """Lost, left over, tiny and empty rows of each source and the limits that they pass."""
    lost = (F.col("doc") + F.col("seg")) % 29 == 0
    rows = seg(spark, d).select("source", F.when(lost, "").otherwise(X.stand_in(F.col("text"))).alias("out"), lost.alias("lost"))
    return audit.corpus_metrics(rows, "source", F.col("lost"), F.col("out").rlike("[À-ÿ]"), F.length("out").between(1, 3), F.col("out") == "")


@query("select event_id, cast(ts as date) as day from (select *, row_number() over (partition by cast(ts as date) order by ts, event_id) as r from events) where r = 1")
def first_tick_of_day(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "event_id")).alias("first")).select(F.col("first.event_id").alias("event_id"), "day")


# -- pair checks of the two main directions: pieces of sentences before every segment, the source's and the target's chosen apart

HU = [
    "A szelepet ki kell nyitni #,5 bar", "Zárja el a csapot és nyissa ki # perc után", "A nyomás értéke # bar 30TL02S001", "A zárójel és a zárókör nyitott primer köre", "A <f1>nyomás</f1> értéke #", "A szivattyú nem indul el, működésképtelenség",
    "Állítsa le a gépet, hirtelen hibátlanul", "Be kell kapcsolni a fűtést #\tm3/h", "Kikapcsolt állapotban felterhelés tilos", "Leterhelni #mbar alatt haladéktalanul",
]
RU = [
    "Закрыть клапан #,5 бар", "Открыть кран и закрыть через # минут", "", "Значение давления 4711 бар 30TL02S001", "Открытый контур", "Значение <f1>давления</f1> #", "Насос запускается, необходимо", "Остановить насос без ошибок, немедленно", "Знaчение # 漢 м³/ч",
    "Выключатель включить, отключено", "Разгрузить до # мбар, не нагружать", "A nyomás értéke # bar", "Отключить насос #", "Нагрузить машину #",
]
RU_SOURCE = ["Давление в контуре # бар", "Давление 12 345 Па и 1 234 567", "Датчик Siemens и Abb_x, # V", "Насос <f1>ONS</f1> не работает", "Уставка 3,5 и 3.7"]
EN_TARGET = ["Pressure in the loop # bar", "Pressure 12,345 Pa and 1,234,567", "Sensor Siemens in контуре # V", "", "Pump <f1>ONS</f1>\toff 漢", "Setting 3.5 and 3.7 of датчик Siemens 4711", "Давление в контуре # бар"]


def _chosen(spark, d, sources, targets):
    """(doc, seg, src, out): a source piece and a target piece by different numbers, each before the segment or what stands for it."""
    from textloom.plans.writing import cyrillic

    q, n, t = F.col("seg"), F.length("text"), F.col("text")
    number = (q % 90 + 100).cast("string")
    pick = lambda xs, k: F.replace(F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int")), F.lit("#"), number)
    target = pick(targets, q * 5 + n)
    body = F.when((F.col("doc") + q * 2) % 11 == 0, "").otherwise(F.get(F.array(cyrillic(t), X.stand_in(t), t), ((F.col("doc") + q) % 3).cast("int")))
    rows = seg(spark, d).select("doc", "seg", F.concat(pick(sources, F.col("doc") + q * 3), F.lit(" "), t).alias("src"), F.when(target == "", "").otherwise(F.concat(target, F.lit(" "), body)).alias("out"))
    return rows


def _checked(spark, d, sources, targets, direction, src_lang, out_lang):
    from textloom.functions import checks as C

    rows = _chosen(spark, d, sources, targets)
    return rows.select("doc", "seg", F.explode(C.issues(F.col("src"), F.col("out"), direction, src_lang, out_lang)).alias("issue"))


def _chosen_sql(sources, targets):
    from textloom.plans.writing import _CYRILLIC, _LATIN

    told = lambda xs: "[" + ", ".join("'" + x.replace("\t", "' || chr(9) || '") + "'" for x in xs) + "]"
    pick = lambda xs, k: f"replace({told(xs)}[({k}) % {len(xs)} + 1], '#', '' || (seg % 90 + 100))"
    return f"""(select doc, seg, {pick(sources, "doc + seg * 3")} || ' ' || text as src, case when {pick(targets, "seg * 5 + length(text)")} = '' then '' else {pick(targets, "seg * 5 + length(text)")} || ' ' || case when (doc + seg * 2) % 11 = 0 then '' when (doc + seg) % 3 = 0 then translate(text, '{_LATIN}', '{_CYRILLIC}') when (doc + seg) % 3 = 1 then {STUB} else text end end as out from {SEG})"""


_PLAIN = "trim(regexp_replace(regexp_replace({0}, '</?f[0-9]+>', '', 'g'), '[\\t\\n\\x0B\\f\\r\\x{{A0}} ]+', ' ', 'g'))"
_OF_NUMBERS = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')))"
_UNGROUPED = "regexp_replace(regexp_replace(regexp_replace({0}, '([0-9])[{1}]([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9])[{1}]([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9])[{1}]([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g')"
#: Rules that both directions share, over (src, out, s, o: without marks, a, b: numbers, gone, left, lost).
_SHARED = """case when list_sort(regexp_extract_all(src, '</?f[0-9]+>')) <> list_sort(regexp_extract_all(out, '</?f[0-9]+>')) then 'marks' end,
    case when length(src) - length(replace(src, chr(9), '')) <> length(out) - length(replace(out, chr(9), '')) then 'breaks' end,
    case when len(gone) > 0 then 'missing_codes: ' || array_to_string(list_sort(gone)[1:6], ', ') end,
    case when len(more) > 0 then 'extra_numbers: ' || array_to_string(list_sort(more)[1:4], ', ') end,
    case when len(lost) > 0 then 'latin_lost: ' || array_to_string(list_sort(lost)[1:6], ', ') end,
    case when len(left_) > 0 and not same then 'source_left: ' || array_to_string(list_sort(left_)[1:6], ', ') end,
    case when regexp_matches(o, '[\\x{3000}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{0E00}-\\x{0E7F}]') then 'foreign_script' end"""
_HU = "a-záéíóöőúüű"
#: Each action: is it in the source, is its opposite, is it in the target, is its opposite.
_ACTED = f"""[{{'n': 'open/close', 'y': regexp_matches(regexp_replace(h, 'nyitott\\s+primer', '#', 'g'), '(^|[^{_HU}])(ki|meg|vissza|be)?nyit'), 'z': regexp_matches(regexp_replace(regexp_replace(h, 'zár(lat|ójel|óvíz|ó\\s+víz)', '#', 'g'), 'zár[{_HU}]*kör', '#', 'g'), '(^|[^{_HU}])(le|be|vissza|el)?zár'), 'c': regexp_matches(r, 'открыт|открыв|откро|открой|открыл'), 'd': regexp_matches(r, 'закрыт|закрыв|закро|закрой|закрыл')}},
    {{'n': 'on/off', 'y': regexp_matches(h, '(^|[^-{_HU}])bekapcsol|(^|[^-\\p{{L}}\\p{{N}}_])be\\s+kell\\s+kapcsolni'), 'z': regexp_matches(h, '(^|[^{_HU}])kikapcsol|(^|[^-\\p{{L}}\\p{{N}}_])ki\\s+kell\\s+kapcsolni'), 'c': regexp_matches(r, '(^|[^а-я])включ'), 'd': regexp_matches(replace(r, 'выключател', '#'), 'отключ|выключ|обесточ')}},
    {{'n': 'start/stop', 'y': regexp_matches(h, '(^|[^{_HU}])(el|újra|vissza)?indít') or regexp_matches(regexp_replace(h, 'indultak\\s+ki', '#', 'g'), '(^|[^{_HU}])indul'), 'z': regexp_matches(replace(h, 'leállás', '#'), 'leállít|leáll'), 'c': regexp_matches(r, 'пуск|запуст|пущен|пусти|пустят'), 'd': regexp_matches(r, 'останов|остана')}},
    {{'n': 'load/unload', 'y': regexp_matches(h, 'felterhel'), 'z': regexp_matches(h, 'leterhel|(^|[^{_HU}])le\\s+és\\s+felterhel'), 'c': regexp_matches(regexp_replace(r, 'разнагру[зж]', '#', 'g'), 'нагру[зж]|набор мощност|набрать мощност|набора мощност'), 'd': regexp_matches(r, 'разгру[зж]|снижени[ея] нагрузк|снизить нагрузк')}}]"""


def _negation_sql() -> str:
    negated = M._NEGATED.replace("(?:", "(")
    words = f"len(list_filter(regexp_extract_all(lower(s), '\\p{{Latin}}{{6,}}'), lambda w: not regexp_matches(w, '^({'|'.join(M.NOT_NEGATIVE)})') and (regexp_matches(w, '{negated}') or regexp_matches(w, '^(inhermetikus|instabil)'))))"
    told = ", ".join(f"'{w}'" for w in M.NEGATING_WORDS)
    tokens = f"len(list_filter(regexp_extract_all(lower(s), '\\p{{Latin}}+'), lambda w: w in ({told})))"
    begin = "|".join(x.replace("(?=", "").replace("])", "]") for x in M.RU_NEGATIVE)
    target = f"len(regexp_extract_all(regexp_replace(lower(o), '(^|[^а-яё])({'|'.join(M.RU_NOT_NEGATIVE)})', '\\1 ', 'g'), '(^|[^а-яё])({begin})'))"
    return f"case when {words} + {tokens} > 0 and {target} < {words} + {tokens} then 'negation_lost' end"


def _codes_sql() -> tuple[str, ...]:
    """Codes of the source, stripped, and those whether one is in the target; a number with a unit counts by its number."""
    hu, units = "[a-záéíóöőúüű]", [u for u, _ in X.UNITS]
    bare = "regexp_replace(x, '^[.,;:()\\-]+|[.,;:()\\-]+$', '', 'g')"
    for form, by in ((f"-{hu}+$", ""), (f"([0-9])\\.{hu}{{2,}}$", "\\1"), (f"([0-9%]){hu}+$", "\\1"), (f"^{hu}+\\.", ""), (f"([0-9])({'|'.join(u for u in units if '/' not in u)})$", "\\1")):
        bare = f"regexp_replace({bare}, '{form}', '{by}')"
    found = f"list_distinct(list_filter(list_transform(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}%_.,:/\\-]*'), lambda x: {bare}), lambda x: regexp_matches(x, '[0-9]')))"
    tidy = "regexp_replace(replace({0}, ' ', ''), '[‑–—]', '-', 'g')"
    low = "|".join(sorted({u.lower() for u in units}, key=lambda u: (-len(u), u)))
    number = f"regexp_extract(lower(x), '^([0-9][0-9.,]*)({low})$', 1)"
    return found, tidy, number, f"contains(tidy, {tidy.format('x')}) or {number} <> '' and contains(tidy, {tidy.format(number)})"


@query(f"""with p as (select *, regexp_replace(src, '</?f[0-9]+>', ' ', 'g') as s, regexp_replace(out, '</?f[0-9]+>', ' ', 'g') as o from {_chosen_sql(HU, RU)}),
    n as (select *, {_OF_NUMBERS.format("s")} as a, {_OF_NUMBERS.format("o")} as b, {_codes_sql()[0]} as codes, {_codes_sql()[1].format("out")} as tidy, lower(s) as h, lower(o) as r,
      list_distinct(list_filter(regexp_extract_all(o, '\\p{{L}}+'), lambda w: regexp_matches(w, '[áéíóöőúüűÁÉÍÓÖŐÚÜŰ]') and contains(s, w))) as left_, cast([] as varchar[]) as lost from p),
    m as (select *, list_filter(codes, lambda x: not ({_codes_sql()[3]})) as gone, list_filter(b, lambda x: not list_contains(a, x) and length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2) as more,
      length(trim(s)) >= 15 and {_PLAIN.format("src")} = {_PLAIN.format("out")} or regexp_matches(s, '\\p{{Latin}}{{3,}}') and not regexp_matches(o, '\\p{{Cyrillic}}') or len(left_) > 0 and 2 * len(left_) > len(regexp_extract_all(o, '\\p{{L}}+')) as same,
      list_filter(list_distinct(list_filter(regexp_extract_all(o, '\\p{{L}}+'), lambda w: regexp_matches(w, '\\p{{Cyrillic}}') and regexp_matches(w, '\\p{{Latin}}'))), lambda w: not list_contains(regexp_extract_all(s, '\\p{{L}}+'), w)) as mixed,
      length(regexp_replace(src, '</?f[0-9]+>', '', 'g')) as n, length(regexp_replace(out, '</?f[0-9]+>', '', 'g')) as k, {_ACTED} as acted from n),
    i as (select doc, seg, case when trim(out) = '' then ['empty'] else list_concat(list_filter([{_SHARED}, case when len(mixed) > 0 then 'mixed_alphabet: ' || array_to_string(list_sort(mixed)[1:4], ', ') end, case when same then 'untranslated' end, case when n >= 25 and not (k / n between 0.5 and 2.6) then 'length' end, {_negation_sql()}], lambda x: x is not null),
      list_transform(list_filter(acted, lambda x: x.y and not x.z and x.d and not x.c or x.z and not x.y and x.c and not x.d), lambda x: 'action_flip ' || x.n)) end as issues from m)
    select doc, cast(seg as integer) as seg, unnest(issues) as issue from i""")
def issue_rows_hu_ru(spark, d):
    return _checked(spark, d, HU, RU, "hu-ru", "hu", "ru")


_NAMES = "list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]+'))"


@query(f"""with p as (select *, regexp_replace(src, '</?f[0-9]+>', ' ', 'g') as s, regexp_replace(out, '</?f[0-9]+>', ' ', 'g') as o from {_chosen_sql(RU_SOURCE, EN_TARGET)}),
    n as (select *, {_OF_NUMBERS.format(_UNGROUPED.format("s", X.THOUSANDS["ru"]))} as a, {_OF_NUMBERS.format(_UNGROUPED.format("o", X.THOUSANDS["en"]))} as b,
      list_distinct(regexp_extract_all(o, '\\p{{Cyrillic}}{{2,}}')) as left_, list_distinct(list_filter({_NAMES.format("s")}, lambda w: not list_contains({_NAMES.format("o")}, w))) as lost from p),
    m as (select *, list_filter(a, lambda x: not list_contains(b, x)) as gone, list_filter(b, lambda x: not list_contains(a, x) and length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2) as more,
      length(trim(s)) >= 15 and {_PLAIN.format("src")} = {_PLAIN.format("out")} or len(left_) > 0 and 2 * len(left_) > len(regexp_extract_all(o, '\\p{{L}}+')) as same,
      length(regexp_replace(src, '</?f[0-9]+>', '', 'g')) as n, length(regexp_replace(out, '</?f[0-9]+>', '', 'g')) as k from n),
    i as (select doc, seg, case when trim(out) = '' then ['empty'] else list_filter([{_SHARED}, case when same then 'untranslated' end, case when n >= 25 and not (k / n between 0.45 and 2.0) then 'length' end], lambda x: x is not null) end as issues from m)
    select doc, cast(seg as integer) as seg, unnest(issues) as issue from i""")
def issue_rows_ru_en(spark, d):
    return _checked(spark, d, RU_SOURCE, EN_TARGET, "ru-en", "ru", "en")
