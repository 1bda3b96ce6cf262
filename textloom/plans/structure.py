"""Queries over predicates, sinks' projections, roles, set algebra and incremental steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import rewrite as R
from textloom.functions import text as X
from textloom.operators import audit, dictionary, geometry, quality, state
from textloom.plans.documents import PAIRS, SEG, pairs, seg
from textloom.plans.layout import BOXES, boxes
from textloom.plans.registry import Registry
from textloom.plans.relational import EDITS, JOBS, edits, jobs
from textloom.sources.tables import table, unprocessed

query = Registry()


@query(f"""select doc, seg, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as source, tgt as target, case when tgt = '' then 'empty' when text = tgt then 'copied' when length(tgt) < 10 then 'short' else '' end as note,
    case when tgt = '' then 'red' when length(tgt) < 10 then 'yellow' else '' end as colour from {PAIRS}""")
def review_sheet(spark, d):
    t = F.col("tgt")
    note = F.when(t == "", "empty").when(F.col("text") == t, "copied").when(F.length(t) < 10, "short").otherwise("")
    colour = F.when(t == "", "red").when(F.length(t) < 10, "yellow").otherwise("")
    return pairs(spark, d).select("doc", "seg", X.control_free(F.col("text")).alias("source"), t.alias("target"), note.alias("note"), colour.alias("colour"))


@query("""select p_brand as section, cast(row_number() over (partition by p_brand order by lower(p_name), p_name, cast(p_partkey as varchar)) as integer) as ord,
    '| ' || replace(p_name, '|', '\\|') || ' | ' || p_partkey || ' |  |' as line from part""")
def snapshot_lines(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("section"), F.col("p_name").alias("src"), F.col("p_partkey").cast("string").alias("tgt"), F.lit(None).cast("string").alias("note"))
    return dictionary.snapshot_lines(rows)


@query(f"""with b as {BOXES}, s as (select page, sum(length(t)) as total, sum(case when id % 5 > 0 then length(t) else 0 end) as rotated from b group by 1) select page, cast(total as bigint) as total, cast(rotated as bigint) as rotated from s where total >= 200 and rotated >= 0.8 * total""")
def rotated_pages(spark, d):
    sums = boxes(spark, d).groupBy("page").agg(F.sum(F.length("t")).alias("total"), F.sum(F.when(F.col("id") % 5 > 0, F.length("t")).otherwise(0)).alias("rotated"))
    return sums.where("total >= 200 and rotated >= 0.8 * total")


@query("select doc_id, n_chars % 100 >= 15 and n_chars % 60 < 0.85 * (n_chars % 100) and (n_chars % 10) / 10 > 0.15 as ocr from documents")
def ocr_routing(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", audit.ocr_routed(n % 100, n % 60, (n % 10) / 10).alias("ocr"))


@query(f"""select doc, seg, text from {SEG} where regexp_full_match(trim(text), '[A-Z][A-Z0-9]{{1,6}}') and trim(text) not in (select upper(p_brand) from part)""")
def lone_abbreviations(spark, d):
    known = table(spark, d, "part").select(F.upper("p_brand").alias("k")).distinct()
    rows = seg(spark, d).where(X.is_lone_abbreviation(F.col("text"))).withColumn("k", F.trim("text"))
    return rows.join(known, "k", "left_anti").select("doc", "seg", "text")


@query(f"""select doc, seg, regexp_matches(tgt, '\\p{{L}}{{3,}}') and tgt <> text as review, tgt <> '' and trim(regexp_replace(tgt, '</?f[0-9]+>', '', 'g')) <> trim(text) as polish from {PAIRS}""")
def eligible_rows(spark, d):
    t = F.col("tgt")
    return pairs(spark, d).select("doc", "seg", (t.rlike(r"\p{L}{3,}") & (t != F.col("text"))).alias("review"), ((t != "") & (F.trim(X.unmarked(t, "")) != F.trim("text"))).alias("polish"))


@query("""select page_id, w from (select page_id, w, list_filter(string_split_regex(trim(w), '[./?&=#:]+'), lambda x: x <> '') as t from (select page_id, url as w from pages))
    where len(t) > 0 and len(list_filter(t, lambda x: not (regexp_matches(x, '[0-9]') or regexp_full_match(x, '[A-Z]{1,4}')))) = 0 and 2 * len(list_filter(t, lambda x: regexp_matches(x, '[0-9]'))) >= len(t)
    union all select c_custkey, substring(c_name, 10) from customer where regexp_matches(substring(c_name, 10), '[0-9]')""")
def code_lines(spark, d):
    urls = table(spark, d, "pages").select("page_id", F.col("url").alias("w")).where(X.code_line(F.regexp_replace("url", "[./?&=#:]+", " ")))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.substr("c_name", F.lit(10)).alias("w"))
    return urls.union(names.where(X.code_line(F.regexp_replace("w", "[^0-9A-Z]+", " "))))


@query(f"""select doc, seg from {PAIRS} where list_sort(regexp_extract_all(text, '</?f[0-9]+>')) = list_sort(regexp_extract_all(tgt, '</?f[0-9]+>'))
    and list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')))) = list_sort(list_distinct(list_transform(regexp_extract_all(tgt, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.'))))
    and length(tgt) / length(text) > 0.6 and length(tgt) / length(text) < 1.6""")
def accepted_rewrites(spark, d):
    return pairs(spark, d).where(R.acceptable(F.col("text"), F.col("tgt"))).select("doc", "seg")


@query(f"""with w as (select distinct doc % 20 as doc, doc as page, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from {SEG}), p as (select doc_id % 20 as doc, count(*) as n from documents group by 1)
    select doc, w from (select doc, w, count(*) as c from w group by 1, 2) join p using (doc) where c >= 0.5 * n""")
def widespread_words(spark, d):
    rows = seg(spark, d).select((F.col("doc") % 20).alias("doc"), F.col("doc").alias("page"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w"))
    pages = table(spark, d, "documents").groupBy((F.col("doc_id") % 20).alias("doc")).agg(F.count("*").alias("n"))
    return audit.widespread(rows, pages)


@query(f"""with b as {BOXES}, c as (select page, x, count(*) as n from (select page, unnest(range(cast(floor(x0 / 20) as bigint), cast(floor(x1 / 20) as bigint) + 1)) as x from b) where x between 6 and 18 group by 1, 2),
    g as (select page, x, coalesce(n, 0) as n from (select distinct page from b) cross join (select unnest(range(6, 19)) as x) left join c using (page, x))
    select page, cast(x as integer) as x, n from (select *, row_number() over (partition by page order by n, x) as r from g) where r = 1""")
def page_gutters(spark, d):
    b = boxes(spark, d)
    cover = b.select("page", F.explode(F.sequence(F.floor(F.col("x0") / 20).cast("int"), F.floor(F.col("x1") / 20).cast("int"))).alias("x")).where("x between 6 and 18").groupBy("page", "x").agg(F.count("*").alias("c"))
    slots = b.select("page").distinct().select("page", F.explode(F.sequence(F.lit(6), F.lit(18))).alias("x"))
    n = slots.join(cover, ["page", "x"], "left").withColumn("n", F.coalesce("c", F.lit(0).cast("long")))
    return n.groupBy("page").agg(F.min(F.struct("n", "x")).alias("m")).select("page", "m.x", "m.n")


@query(f"""with b as {BOXES}, c as (select page, line as id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b where line % 2 = 0 group by 1, 2),
    m as (select b.page, b.id, c.id as cell, (c.x1 - c.x0) * (c.y1 - c.y0) as area from b join c on b.page = c.page and (b.x0 + b.x1) / 2 between c.x0 and c.x1 and (b.y0 + b.y1) / 2 between c.y0 and c.y1)
    select page, cast(id as integer) as id, cell from (select *, row_number() over (partition by page, id order by area, cell) as r from m) where r = 1""")
def cell_assignment(spark, d):
    b = boxes(spark, d)
    cells = geometry.unions(b.where("line % 2 = 0"), ["page", "line"]).withColumnRenamed("line", "id")
    return geometry.contained(b, cells)


@query("""with l as (select page_id as page, list_filter(list_transform(string_split_regex(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '') as t from pages),
    s as (select distinct page, i // 4 as bucket, regexp_replace(t[i + 1], '[0-9]+', '#', 'g') as sig from (select page, t, unnest(range(len(t))) as i from l)),
    w as (select distinct page, sig, bucket + o as bucket from s cross join (select unnest([-1, 0, 1]) as o))
    select sig, bucket, count(*) as pages from w group by 1, 2 having count(*) >= 20""")
def running_lines_by_place(spark, d):
    from textloom.sources.tables import page_lines

    rows = page_lines(table(spark, d, "pages")).select("page", F.floor(F.col("pos") / 4).alias("bucket"), X.digit_signature(F.col("text")).alias("sig")).distinct()
    b = F.col("bucket")
    near = rows.select("page", "sig", F.explode(F.array(b - 1, b, b + 1)).alias("bucket")).distinct()
    return near.groupBy("sig", "bucket").agg(F.count("*").alias("pages")).where("pages >= 20")


@query(f"""select doc, seg, case when contains(text, ' | ') then 'table' when regexp_matches(text, '^[-*•] ') then 'item' when regexp_matches(text, '[.]{{3,}} *[0-9]+$') then 'toc' when length(text) < 40 and text <> '' and not regexp_matches(text, '[.!?]$') then 'heading'
    when length(text) > 0 and upper(text) = text and lower(text) <> text then 'heading' else 'body' end as role from {SEG}""")
def row_roles(spark, d):
    t = F.col("text")
    role = (
        F.when(t.contains(" | "), "table").when(t.rlike("^[-*•] "), "item").when(t.rlike(r"[.]{3,} *[0-9]+$"), "toc")
        .when((F.length(t) < 40) & (t != "") & ~t.rlike("[.!?]$"), "heading").when((F.length(t) > 0) & (F.upper(t) == t) & (F.lower(t) != t), "heading").otherwise("body")
    )
    return seg(spark, d).select("doc", "seg", role.alias("role"))


@query(f"""with q as (select job, cast(row_number() over (order by created, job) as integer) as position from {JOBS} where status = 'O')
    select j.job, c_name as owner_name, status, position from {JOBS} j join customer on c_custkey = owner left join q using (job)""")
def job_views(spark, d):
    rows = jobs(spark, d)
    queued = state.numbered(rows.where("status = 'O'").select("created", "job"), ["created", "job"], "position").select("job", F.col("position").cast("int").alias("position"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("owner_name"))
    return rows.join(users, "owner").join(queued, "job", "left").select("job", "owner_name", "status", "position")


@query("select lower(p_name) as k, count(*) as variants from part group by 1 having count(*) > 1")
def candidate_conflicts(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("k")).agg(F.count("*").alias("variants")).where("variants > 1")


@query(f"select coalesce(nullif(author % 7, 0), job % 7) as author, count(*) as items from {EDITS} group by 1")
def items_by_author(spark, d):
    author = F.coalesce(F.nullif(F.col("author") % 7, F.lit(0)), F.col("job") % 7)
    return edits(spark, d).groupBy(author.alias("author")).agg(F.count("*").alias("items"))


@query(f"""select doc, seg, coalesce(array_to_string(list_transform(regexp_extract_all(replace(text, ' ', chr(9)), '\\t+|[^\\t]+'), lambda x: case when x[1] <> chr(9) then x when length(x) = 1 then '[TAB]' else '[TAB×' || length(x) || ']' end), ''), '') as marked,
    replace(text, ' ', chr(9)) as back from {SEG}""")
def tab_marks(spark, d):
    rows = seg(spark, d).select("doc", "seg", X.runs_marked(F.replace("text", F.lit(" "), F.lit("\t"))).alias("marked"))
    return rows.withColumn("back", X.runs_expanded("marked"))


@query(f"select job, segments, case when segments % 10 = 1 and segments % 100 <> 11 then 'one' when segments % 10 between 2 and 4 and not segments % 100 between 12 and 14 then 'few' else 'many' end as form, case when segments > 0 then round(10.0 / segments * (500 - segments), 1) end as eta from {JOBS}")
def plural_and_eta(spark, d):
    n = F.col("segments")
    return jobs(spark, d).select("job", "segments", X.decade_plural(n, "one", "few", "many").alias("form"), X.fraction_eta(F.lit(10.0), n, F.lit(500)).alias("eta"))


@query("select doc_id, source from documents where source not in (select source from documents where doc_id % 50 = 0)")
def incremental_inputs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return unprocessed(docs, docs.where("doc_id % 50 = 0"), "source").select("doc_id", "source")


@query(f"select job from {JOBS} where owner = 7 or 7 in (select c_custkey from customer where c_acctbal > 9000)")
def access_filter(spark, d):
    user = table(spark, d, "customer").where("c_custkey = 7").agg(F.coalesce(F.bool_or(F.col("c_acctbal") > 9000), F.lit(False)).alias("admin"))
    return quality.owned(jobs(spark, d).join(F.broadcast(user), F.lit(True)), F.lit(7), F.col("admin")).select("job")


@query(f"select text, tgt, min(doc) as doc, count(*) as n from {PAIRS} where tgt <> '' group by 1, 2")
def pairs_reviewed_once(spark, d):
    return pairs(spark, d).where("tgt <> ''").groupBy("text", "tgt").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))


@query(f"""with m as (select doc, seg, text from {SEG} where text <> '' and text not in (select text from {SEG} where doc % 3 = 0) and doc % 3 = 1), x as (select max(doc) as top from {SEG})
    select doc, seg, top + row_number() over (order by doc, seg) as new_id from m, x""")
def missing_ids(spark, d):
    rows = seg(spark, d)
    top = rows.agg(F.max("doc").alias("top"))
    new = rows.where("text <> '' and doc % 3 = 1").join(rows.where("doc % 3 = 0").select("text").distinct(), "text", "left_anti")
    return state.numbered(new.select("doc", "seg"), ["doc", "seg"], "n").join(F.broadcast(top), F.lit(True)).select("doc", "seg", (F.col("top") + F.col("n")).alias("new_id"))


@query("""select doc_id, list_reduce(string_split(text, chr(10)), lambda acc, x: case when acc = '' then x when regexp_matches(right(acc, 2), '\\p{Ll}-$') and regexp_matches(left(x, 1), '\\p{Ll}') then left(acc, length(acc) - 1) || x
    when regexp_matches(right(acc, 2), '[\\p{Lu}0-9]-$') then acc || x else acc || ' ' || x end) as joined from documents where text is not null""")
def lines_joined(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", R.joined_lines(F.split("text", "\n")).alias("joined"))


_W = "select unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as w from documents where doc_id % 2 = {0}"


def _words(spark, d, k):
    return table(spark, d, "documents").where(F.col("doc_id") % 2 == k).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w"))


@query(f"select w, count(*) as n from ({_W.format(0)} except all {_W.format(1)}) group by 1")
def corpus_word_surplus(spark, d):
    return _words(spark, d, 0).exceptAll(_words(spark, d, 1)).groupBy("w").agg(F.count("*").alias("n"))


@query(f"select w, count(*) as n from ({_W.format(0)} intersect all {_W.format(1)}) group by 1")
def corpus_words_common(spark, d):
    return _words(spark, d, 0).intersectAll(_words(spark, d, 1)).groupBy("w").agg(F.count("*").alias("n"))


@query("select doc_id % 50 as page, count(*) as lines, cast(sum(case when quality is not null then 1 else 0 end) as bigint) as labelled from documents left join labels using (doc_id) group by 1 having sum(case when quality is not null then 1 else 0 end) >= 0.4 * count(*)")
def label_coverage(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy((F.col("doc_id") % 50).alias("page")).agg(F.count("*").alias("lines"), F.sum(F.when(F.col("quality").isNotNull(), 1).otherwise(0)).alias("labelled")).where("labelled >= 0.4 * lines")


@query("select c_custkey from customer where c_nationkey <> (select min(n_nationkey) from nation where n_regionkey = 1)")
def deleted_by_subquery(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1").agg(F.min("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(F.broadcast(gone), "c_nationkey", "left_anti").select("c_custkey")


@query(f"""with s as (select doc, seg, length(text) as n, length(text) > 0 and not contains(text, ' | ') and length(text) < 60 as short from {SEG}), i as (select doc, seg, short, seg - row_number() over (partition by doc, short order by seg) as k from s)
    select doc, cast(min(seg) as integer) as first, count(*) as rows from i where short group by doc, k having count(*) >= 3""")
def short_row_tables(spark, d):
    from textloom.operators import order

    t = F.col("text")
    rows = seg(spark, d).where((F.length(t) > 0) & ~t.contains(" | ") & (F.length(t) < 60)).withColumn("label", F.lit(1))
    return order.runs(rows, ["doc"], "seg", "label").where("length >= 3").select("doc", F.col("start").alias("first"), F.col("length").alias("rows"))
