"""Queries over cells, pictures, fields and the order of blocks; the rows are derived from whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import cells, cover, fields, figures, flow, geometry, tree, zones
from textloom.plans.documents import SEG, seg
from textloom.plans.layout import BOXES, boxes, page_texts
from textloom.plans.registry import Registry
from textloom.sources.tables import page_lines, table

query = Registry()

# -- rows of tables (a page's lines are dealt to rows of 2 to 7 cells over frames of five columns)

_CELLS = """(with l as (select page_id as page, list_filter(list_transform(string_split_regex(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '') as t from pages),
    b as (select page, pos // (2 + page % 6) as row, pos % (2 + page % 6) as j, 2 + page % 6 as n, text, length(text) as len from (select page, unnest(range(len(t))) as pos, unnest(t) as text from l)),
    g as (select page, row, j, text, case when len % 11 = 0 then null else j * (480.0 // n) + len % 23 :: double end as x0, case when len % 11 = 0 then null else j * (480.0 // n) + len % 23 + least(len * 3, 150) end :: double as x1 from b)
    select page, row, [0.0, 90.0 + page % 7 * 4, 200.0, 290.0 + page % 3 * 8, 400.0, 490.0] as xs, list({'x0': x0, 'x1': x1, 'text': text} order by j) as cells from g group by page, row)"""


def table_rows(spark, d):
    rows = page_lines(table(spark, d, "pages")).withColumn("n", 2 + F.col("page") % 6)
    rows = rows.select("page", F.floor(F.col("pos") / F.col("n")).alias("row"), (F.col("pos") % F.col("n")).alias("j"), "n", "text", F.length("text").alias("len"))
    x0 = F.col("j") * (F.lit(480.0) / F.col("n")) + F.col("len") % 23
    x1 = x0 + F.least(F.col("len") * 3, F.lit(150))
    put = lambda x: F.when(F.col("len") % 11 != 0, x).cast("double")
    got = rows.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("j", put(x0).alias("x0"), put(x1).alias("x1"), "text"))).alias("c"))
    xs = F.array(F.lit(0.0), 90.0 + F.col("page") % 7 * 4, F.lit(200.0), 290.0 + F.col("page") % 3 * 8, F.lit(400.0), F.lit(490.0))
    return got.select("page", "row", xs.alias("xs"), F.transform("c", lambda c: F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), c["text"].alias("text"))).alias("cells"))


_COLUMN = "case when c.x1 is null then null else len(list_filter(xs[2:-2], lambda x: (c.x0 + c.x1) / 2 >= x)) end"
_MERGED = f"""(with r as (select page, row, xs, cells, unnest(cells) as c, unnest(range(len(cells))) as i from {_CELLS}),
    k as (select page, row, xs, cells, c, i, {_COLUMN} as col from r),
    p as (select *, lag(col) over (partition by page, row order by i) as before from k),
    f as (select page, row, any_value(xs) as xs, any_value(cells) as cells, len(any_value(cells)) > 5 and bool_and(i = 0 or col is not null) and bool_and(i < 2 or col >= before) as fine, count(*) filter (i = 0 or before is null or before <> col) as groups from p group by 1, 2),
    g as (select page, row, i, c, sum(case when i = 0 or before is null or before <> col then 1 else 0 end) over (partition by page, row order by i) as g from p),
    m as (select page, row, g, {{'x0': min(c.x0), 'x1': max(c.x1), 'text': string_agg(c.text, chr(10) order by i)}} as c from g group by 1, 2, 3),
    j as (select page, row, list(c order by g) as joined from m group by 1, 2)
    select page, row, xs, case when fine and groups <= 5 then joined else cells end as cells from f join j using (page, row))"""


@query(f"select page, cast(row as bigint) as row, len(cells) as n, array_to_string(list_transform(cells, lambda c: replace(c.text, chr(10), ' / ')), ' | ') as texts from {_MERGED}")
def table_cells_merged(spark, d):
    """Rows with more cells than their frame has columns: cells of one column are joined."""
    got = cells.merged(table_rows(spark, d))
    return got.select("page", "row", F.size("cells").cast("long").alias("n"), F.array_join(F.transform("cells", lambda c: F.replace(c["text"], F.lit("\n"), F.lit(" / "))), " | ").alias("texts"))


@query(f"""with recursive r as materialized (select page, row, xs, cells, len(cells) as k from {_MERGED} where len(cells) <= 5),
    w as (select page, row, 0 as i, 0 as reach, 0.0 :: double as cost, cast([] as integer[]) as firsts, cast([] as integer[]) as lasts from r
      union all select page, row, w.i + 1, z + 1, cost + 25.0 * (a - reach) + case when c.x0 is null then 5.0 * (z - a) else case when xs[a + 1] - 3 <= c.x0 and c.x1 <= xs[z + 2] + 3 then 0.0 else 1000.0 end
          + 30.0 * len(list_filter(xs[a + 2 : z + 1], lambda x: c.x1 < x + 3)) + least(abs((xs[a + 1] + xs[z + 2]) / 2 - (c.x0 + c.x1) / 2), abs(c.x0 - xs[a + 1] - 5)) end, list_append(firsts, a), list_append(lasts, z)
      from (select w.*, r.xs, r.k, r.cells[w.i + 1] as c from w join r using (page, row) where w.i < r.k) as w, (select a :: integer as a, z :: integer as z from range(5) as s(a), range(5) as t(z) where a <= z) as span where a >= w.reach),
    best as (select page, row, min_by(struct_pack(cost := cost + 25.0 * (5 - reach), firsts := firsts, lasts := lasts), (cost + 25.0 * (5 - reach), list_transform(list_zip(firsts, lasts), lambda x: x[1] * 10 + x[2]))) as b from w join r using (page, row) where w.i = r.k group by 1, 2)
    select page, cast(row as bigint) as row, case when b.cost < 1000 and len(list_filter(cells, lambda c: c.x0 is not null)) > 0 then array_to_string(list_transform(list_zip(b.firsts, b.lasts), lambda x: x[1] || '-' || x[2]), ' ')
      else array_to_string(list_transform(range(k), lambda i: i || '-' || case when i = k - 1 then 4 else i end), ' ') end as spans from best join r using (page, row)""")
def table_rows_placed(spark, d):
    """Rows of at most as many cells as columns: the columns of each cell at the least cost."""
    got = cells.placed(cells.merged(table_rows(spark, d)).where(F.size("cells") <= 5))
    return got.select("page", "row", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), " ").alias("spans"))


# -- hidden text (words are drawn in an order of their own; every page has opaque or masked pictures, some texts are never painted)

_ITEMS = f"""(with b as (select * from {BOXES}), p as (select page, count(*) as n, max(y1) as h from b group by 1)
    select page, id, (id * 7919) % n as ord, case when length(t) % 13 = 0 then 'unseen' else 'text' end as kind, false as opaque, 480.0 * h as page_area, x0, y0, x1, y1 from b join p using (page)
    union all select page, -1, n // 2, 'image', page % 4 <> 1, 480.0 * h, -20.0, -5.0, 640.0, h + 5 from p where page % 4 in (0, 1)
    union all select page, -2, n + 1, 'image', true, 480.0 * h, -20.0, -5.0, 640.0, h + 5 from p where page % 4 = 2
    union all select page, -3, n * 3 // 10, 'image', true, 480.0 * h, -20.0, 0.4 * h, 640.0, h + 5 from p where page % 4 = 3
    union all select page, -4, n * 6 // 10, 'image', true, 480.0 * h, -20.0, -5.0, 300.0, h + 5 from p where page % 4 = 3)"""


def drawn_items(spark, d):
    p = boxes(spark, d).groupBy("page").agg(F.count("*").alias("n"), F.max("y1").alias("h"))
    # whole texts meet the numbers of their page, not each word; the words are then dealt by page
    b = geometry.token_boxes(page_texts(spark, d).join(p.hint("merge"), "page"), keep=("n", "h"))
    texts = b.select("page", "id", ((F.col("id") * 7919) % F.col("n")).alias("ord"), F.when(F.length("t") % 13 == 0, "unseen").otherwise("text").alias("kind"), F.lit(False).alias("opaque"), (480.0 * F.col("h")).alias("page_area"), "x0", "y0", "x1", "y1")
    h, kind = F.col("h"), F.col("page") % 4

    def image(no, ord_, where, opaque, x1, y0):
        return F.when(where, F.struct(F.lit(no).alias("id"), F.floor(ord_).alias("ord"), opaque.alias("opaque"), y0.alias("y0"), F.lit(x1).alias("x1")))

    n, yes, top = F.col("n"), F.lit(True), F.lit(-5.0)
    images = [image(-1, n / 2, kind.isin(0, 1), kind != 1, 640.0, top), image(-2, n + 1, kind == 2, yes, 640.0, top), image(-3, n * 3 / 10, kind == 3, yes, 640.0, 0.4 * h), image(-4, n * 6 / 10, kind == 3, yes, 300.0, top)]
    i = p.select("page", "h", F.explode(F.array_compact(F.array(*images))).alias("i"))
    return texts.unionByName(i.select("page", "i.id", "i.ord", F.lit("image").alias("kind"), "i.opaque", (480.0 * h).alias("page_area"), F.lit(-20.0).alias("x0"), "i.y0", "i.x1", (h + 5).alias("y1")))


_HIDDEN = f"""(with i as materialized (select * from {_ITEMS}), big as (select page, ord, x0, y0, x1, y1 from i where kind = 'image' and opaque and (x1 - x0) * (y1 - y0) >= 0.5 * page_area),
    t as (select *, exists (select 1 from big where big.page = i.page and big.ord > i.ord and big.x0 <= i.x0 and big.y0 <= i.y0 and big.x1 >= i.x1 and big.y1 >= i.y1) as under from i where kind = 'text'),
    fine as (select page from t group by 1 having count(*) filter (under) <= 0.7 * count(*))
    select page, id, x0, y0, x1, y1 from t where under and page in (select page from fine) union all select page, id, x0, y0, x1, y1 from i where kind = 'unseen')"""


@query(f"select page, cast(id as integer) as id from {_HIDDEN}")
def hidden_texts(spark, d):
    return cover.hidden_text(drawn_items(spark, d)).select("page", "id")


_LINE_BOXES = f"(select page, line as id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from {BOXES} group by 1, 2)"


@query(f"""with c as materialized (select l.page, l.id, (l.x1 - l.x0) * (l.y1 - l.y0) as size, greatest(l.x0, h.x0) as x0, greatest(l.y0, h.y0) as y0, least(l.x1, h.x1) as x1, least(l.y1, h.y1) as y1 from {_LINE_BOXES} as l join (select *, unnest(range(cast(floor(y0 / 12.0) as bigint) - 2, cast(floor(y0 / 12.0) as bigint) + 2)) as line from {_HIDDEN}) as h on l.page = h.page and l.id = h.line
      where least(l.x1, h.x1) > greatest(l.x0, h.x0) and least(l.y1, h.y1) > greatest(l.y0, h.y0)),
    x as (select page, id, a, lead(a) over (partition by page, id order by a) as b from (select distinct page, id, unnest([x0, x1]) as a from c)),
    y as (select page, id, a, lead(a) over (partition by page, id order by a) as b from (select distinct page, id, unnest([y0, y1]) as a from c)),
    e as (select distinct page, id, x.a as xa, x.b as xb, y.a as ya, y.b as yb from x join y using (page, id) join c using (page, id) where x.b is not null and y.b is not null and c.x0 <= x.a and c.x1 >= x.b and c.y0 <= y.a and c.y1 >= y.b),
    s as (select page, id, sum((xb - xa) * (yb - ya)) as area from e group by 1, 2)
    select page, id, round(area / size, 6) as covered from s join (select distinct page, id, size from c) using (page, id) where round(area / size, 6) >= 0.5""")
def hidden_lines(spark, d):
    """Lines at least half of which hidden words take; what several of them take counts once."""
    lines = geometry.unions(boxes(spark, d), ["page", "line"]).withColumnRenamed("line", "id")
    return cover.covered_share(lines, cover.hidden_text(drawn_items(spark, d)))


# -- figures (words that start with a capital or a digit are shapes, lines of other words are texts)


def figure_parts(spark, d):
    b = boxes(spark, d).withColumn("shape", F.col("t").rlike("^[A-Z0-9À-Ý]"))
    shapes = b.where("shape").select("page", "id", "x0", "y0", "x1", "y1")
    return shapes, b.where("not shape").select("page", "id", "x0", "y0", "x1", "y1")


@query()
def figure_clusters(spark, d):
    """Clusters of shapes whose boxes stay apart; no SQL, as links follow the boxes that grow: tests hold it against plain loops."""
    return figures.grown(figure_parts(spark, d)[0], 9.0)


@query()
def figures_with_captions(spark, d):
    shapes, texts = figure_parts(spark, d)
    return figures.figures(shapes, texts.where(F.col("id") % 3 == 0), 9.0, 3, 60.0, 10.0, 1)


# -- field runs (the words of a document are runs: begins, separators, ends, instructions and texts by their length)

_RUNS = """(select doc_id as part, seq, case length(t) % 11 when 3 then 'begin' when 5 then 'separate' when 7 then 'end' when 9 then 'instr' else 'text' end as kind,
    case when length(t) % 11 = 9 then [' PAGE ', 'DATE \\@ "d"', ' REF x1', 'PAGEREF y', 'HYPERLINK z'][seq % 5 + 1] when seq % 37 = 0 then '☐ ' when seq % 5 = 0 then '' || seq else t end as text,
    case when seq % 53 = 0 then 'Wingdings 2' end as font, case seq % 59 when 0 then ' NUMPAGES ' when 1 then 'AUTHOR' end as simple
    from (select doc_id, unnest(range(len(w))) as seq, unnest(w) as t from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents where text is not null)))"""


def runs(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("part"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("seq", "t"))
    k, q = F.length("t") % 11, F.col("seq")
    kind = F.when(k == 3, "begin").when(k == 5, "separate").when(k == 7, "end").when(k == 9, "instr").otherwise("text")
    told = F.get(F.array(*map(F.lit, (" PAGE ", 'DATE \\@ "d"', " REF x1", "PAGEREF y", "HYPERLINK z"))), q % 5)
    text = F.when(k == 9, told).when(q % 37 == 0, "☐ ").when(q % 5 == 0, q.cast("string")).otherwise(F.col("t"))
    simple = F.when(q % 59 == 0, " NUMPAGES ").when(q % 59 == 1, "AUTHOR")
    return rows.select("part", "seq", kind.alias("kind"), text.alias("text"), F.when(q % 53 == 0, "Wingdings 2").alias("font"), simple.alias("simple"))


@query(f"""with r as materialized (select *, case kind when 'begin' then 1 when 'end' then -1 else 0 end as step from {_RUNS}),
    s as (select *, sum(step) over (partition by part order by seq) as plain from r),
    h as (select *, plain - least(min(plain) over (partition by part order by seq), 0) as height from s),
    o as (select *, case when kind <> 'end' and height > 0 then max(case when kind = 'begin' then seq end) over (partition by part, height order by seq) end as opened from h),
    p as (select *, opened is not null and max(case when kind = 'separate' then 1 else 0 end) over (partition by part, opened order by seq) = 1 as result from o),
    i as (select part, opened, string_agg(text, '' order by seq) as instruction from p where kind = 'instr' and opened is not null group by 1, 2),
    w as (select p.part, p.seq, case when regexp_matches(simple, '^\\s*(PAGE|NUMPAGES|SECTIONPAGES)\\b') or result and regexp_matches(instruction, '^\\s*(PAGE|NUMPAGES|SECTIONPAGES)\\b') then 'page'
        when result and regexp_matches(instruction, '^\\s*(DOCPROPERTY|REVNUM|NUMWORDS|NUMCHARS|FILESIZE|DATE|TIME|SAVEDATE|PRINTDATE|CREATEDATE|REF|NOTEREF)\\b') and not regexp_matches(text, '\\p{{L}}') then 'data'
        when regexp_full_match(text, '[-☐☒□■▪●○✓✔\\s]+') and trim(text) <> '' or regexp_matches(font, 'Wingdings|Symbol|Webdings') then 'sign' end as why from p left join i on p.part = i.part and p.opened = i.opened where kind = 'text')
    select part, cast(seq as integer) as seq, why from w where why is not null""")
def computed_runs(spark, d):
    """Runs that are results of computed fields, or signs."""
    return fields.computed_runs(runs(spark, d))


# -- order of blocks (segments are blocks, a dozen to a page; some stand far from their page, some have none)

_BLOCKS = f"""(select doc, seg as ord, case when seg % 23 = 7 and length(text) % 2 = 0 then seg // 12 + 9 when seg % 31 = 0 and seg > 0 then null else seg // 12 end as page,
    case when length(text) % 17 = 3 then 'image' when contains(text, ' | ') then 'table' when length(text) % 29 = 5 then 'toc' when length(text) between 1 and 45 then 'h' else 'p' end as kind,
    case when seg % 12 = 0 then 72.0 else 72.0 + seg % 12 * (20 + (seg // 12 * 7 + doc) % 30) end as top, 72.0 + seg % 12 * (20 + (seg // 12 * 7 + doc) % 30) + 14 + length(text) % 40 as bottom, 'f' || length(text) % 3 as look,
    case when length(text) < 30 then 1 else 2 end as level, len(regexp_extract_all(text, '[^ ]+')) as words, right(text, 1) as end_, text from {SEG})"""


def blocks(spark, d):
    t, q = F.col("text"), F.col("seg")
    n = F.length(t)
    home = F.floor(q / 12)
    page = F.when((q % 23 == 7) & (n % 2 == 0), home + 9).when((q % 31 == 0) & (q > 0), None).otherwise(home)
    kind = F.when(n % 17 == 3, "image").when(t.contains(" | "), "table").when(n % 29 == 5, "toc").when(n.between(1, 45), "h").otherwise("p")
    y = 72.0 + q % 12 * (20 + (home * 7 + F.col("doc")) % 30)
    return seg(spark, d).select(
        "doc", q.cast("long").alias("ord"), page.alias("page"), kind.alias("kind"), F.when(q % 12 == 0, 72.0).otherwise(y).alias("top"), (y + 14 + n % 40).alias("bottom"), (y + 12).alias("first_bottom"),
        F.concat(F.lit("f"), n % 3).alias("look"), F.when(n < 30, 1).otherwise(2).alias("level"), F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), 0)).alias("words"), F.right("text", F.lit(1)).alias("end"), "text",
    )


@query(f"""with b as materialized (select doc, ord, page from {_BLOCKS}),
    n as (select *, case when page is not null and (page <> lag(page ignore nulls) over (partition by doc order by ord) or lag(page ignore nulls) over (partition by doc order by ord) is null) then 1 else 0 end as new from b),
    r as (select *, sum(new) over (partition by doc order by ord) as run from n),
    p as (select doc, run, any_value(page) as rp from r where page is not null group by 1, 2),
    s as (select *, coalesce(abs(rp - lag(rp) over w) > 2 and abs(rp - lead(rp) over w) > 2 and lag(rp) over w <= lead(rp) over w, false) as stray from p window w as (partition by doc order by run)),
    m as materialized (select r.doc, r.ord, r.page, coalesce(stray, false) as moved, rp from r left join s on r.doc = s.doc and r.run = s.run),
    f as (select x.doc, x.rp, min(y.ord) as at from (select distinct doc, rp from m where moved) as x left join m as y on x.doc = y.doc and not y.moved and coalesce(y.page, 0) >= x.rp group by 1, 2),
    g as (select doc, ord, rp, sum(case when before = rp then 0 else 1 end) over (partition by doc order by ord) as g from (select doc, ord, rp, lag(rp) over (partition by doc order by ord) as before from m where moved)),
    o as (select m.doc, m.ord, m.moved, case when m.moved then coalesce(f.at, 9000000000) else m.ord end as k1, case when m.moved then 0 else 1 end as k2, case when m.moved then m.rp end as k3, case when m.moved then -g.g end as k4 from m left join f on m.doc = f.doc and m.rp = f.rp and m.moved left join g on m.doc = g.doc and m.ord = g.ord)
    select doc, cast(ord as bigint) as ord, moved, cast(row_number() over (partition by doc order by k1, k2, k3, k4, ord) - 1 as integer) as place from o""")
def blocks_reordered(spark, d):
    return flow.reordered(blocks(spark, d)).select("doc", "ord", "moved", "place")


@query(f"""with b as materialized (select *, 72.0 + ord % 12 * (20 + (ord // 12 * 7 + doc) % 30) + 12 as first_bottom from {_BLOCKS}),
    p as (select doc, page, min(top) as t, max(bottom) as u from b where page is not null group by 1, 2),
    l as (select doc, list(u order by u)[cast(floor(count(*) * 4 / 5) as bigint) + 1] as low from p group by 1),
    j as (select b.*, p.t, q.u as before, low from b left join p on b.doc = p.doc and b.page = p.page left join p as q on b.doc = q.doc and b.page = q.page + 1 left join l on b.doc = l.doc),
    c as (select *, lead(kind, 1) over w as k1, lead(kind, 2) over w as k2, lead(kind, 3) over w as k3, lead(page, 1) over w as p1, lead(page, 2) over w as p2, lead(page, 3) over w as p3,
        case when kind = 'table' then first_bottom else bottom end as reach, lead(case when kind = 'table' then first_bottom else bottom end, 1) over w as r1, lead(case when kind = 'table' then first_bottom else bottom end, 2) over w as r2, lead(case when kind = 'table' then first_bottom else bottom end, 3) over w as r3,
        row_number() over (partition by doc, page order by ord) = 1 as first from j window w as (partition by doc order by ord)),
    a as (select *, case when kind in ('table', 'image') then reach when k1 in ('table', 'image') and p1 = page then r1 when k2 in ('table', 'image') and p2 = page then r2 when k3 in ('table', 'image') and p3 = page then r3 end as ahead from c),
    k as materialized (select *, coalesce(page is not null and low - before > 72 and case when kind = 'toc' then first when kind = 'image' then false else abs(top - t) < 2 and not coalesce(ahead - t > low - before, false) end, false) as brk from a),
    h as (select doc, look, top from k where kind = 'h' and level = 1 and brk and doc in (select doc from k where kind = 'h' and level = 1 and brk group by 1 having count(*) >= 2)),
    x as (select doc, ord from k where kind = 'p' and not brk and abs(top - t) < 2 and words between 1 and 6 and end_ not in ('.', ':', ';', ',') and exists (select 1 from h where h.doc = k.doc and h.look = k.look) and exists (select 1 from h where h.doc = k.doc and abs(h.top - k.top) < 6))
    select doc, cast(ord as bigint) as ord from k where brk or (doc, ord) in (select doc, ord from x)""")
def forced_page_breaks(spark, d):
    return flow.page_breaks(blocks(spark, d)).where("break").select("doc", "ord")


# -- zones (every page of words has verticals and pieces of horizontals; as zones without rules, wide spaces part the columns)

_RULES = f"""(with p as (select page, max(y1) as h from {BOXES} group by 1)
    select page, j * 120.0 + page % 5 + dup * 1.5 as x0, -2.0 as y0, j * 120.0 + page % 5 + dup * 1.5 + 1 as x1, h + 2 as y1 from p, range(5) as a(j), range(2) as b(dup) where dup = 0 or j % 2 = page % 2
    union all select page, c * 120.0, k * 36.0 - 2, c * 120.0 + 118, k * 36.0 - 1 from (select page, unnest(range(cast(ceil(h / 36.0) as bigint) + 1)) as k from p), range(4) as a(c) where (k * 2 + c + page) % 3 <> 0 or k = 0)"""


def rule_boxes(spark, d):
    p = boxes(spark, d).groupBy("page").agg(F.max("y1").alias("h"))
    v = p.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("dup", F.explode(F.array(F.lit(0), F.lit(1))))
    v = v.where((F.col("dup") == 0) | (F.col("j") % 2 == F.col("page") % 2))
    x = F.col("j") * 120.0 + F.col("page") % 5 + F.col("dup") * 1.5
    v = v.select("page", x.alias("x0"), F.lit(-2.0).alias("y0"), (x + 1).alias("x1"), (F.col("h") + 2).alias("y1"))
    k = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / 36.0)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(((F.col("k") * 2 + F.col("c") + F.col("page")) % 3 != 0) | (F.col("k") == 0))
    return v.unionByName(k.select("page", (F.col("c") * 120.0).alias("x0"), (F.col("k") * 36.0 - 2).alias("y0"), (F.col("c") * 120.0 + 118).alias("x1"), (F.col("k") * 36.0 - 1).alias("y1")))


_FIRST_OF = "(select distinct page, {0} from (select page, {0}, {0} - lag({0}) over (partition by page order by {0}) as gap from (select distinct page, {0} from {1})) where gap is null or gap > 2.5)"


@query(f"""with b as materialized (select * from {BOXES}), r as materialized (select * from {_RULES}),
    v as (select page, (x0 + x1) / 2 as x from r where x1 - x0 < 3 and y1 - y0 > 5), l as (select page, (y0 + y1) / 2 as y, x0, x1 from r where y1 - y0 < 3 and x1 - x0 > 20),
    cx as (select page, x as a, lead(x) over (partition by page order by x) as b, cast(row_number() over (partition by page order by x) - 1 as integer) as col from {_FIRST_OF.format("x", "v")}),
    cy as (select page, y, lead(y) over (partition by page order by y) as z, cast(row_number() over (partition by page order by y) - 1 as integer) as row from {_FIRST_OF.format("y", "l")}),
    c as materialized (select page, row, col, a, b, y, z, row = 0 or exists (select 1 from l where l.page = cx.page and abs(l.y - cy.y) <= 2 and least(l.x1, cx.b) - greatest(l.x0, cx.a) >= 0.5 * (cx.b - cx.a)) as ruled from cx join cy using (page)
      where b is not null and z is not null and page in (select page from cx group by 1 having count(*) >= 3)),
    o as materialized (select *, max(case when ruled then row end) over (partition by page, col order by row) as top from c),
    w as (select b.page, b.id, t, b.x0, b.x1, round_even(b.y0 / 3, 0) as line, min(o.row) as row, min(o.col) as col from b join o on b.page = o.page and (b.x0 + b.x1) / 2 between o.a and o.b and (b.y0 + b.y1) / 2 between o.y and o.z group by all),
    g as (select o.page, o.top, o.col, o.a, o.b, line, min(w.x0) as x0, max(w.x1) as x1, string_agg(t, ' ' order by w.x0, w.id) as text from o left join w using (page, row, col) group by all),
    n as (select page, top, col, count(*) - 1 as below from o group by all),
    s as (select page, top, col, a, b, min(x0) - a as l, b - max(x1) as r, string_agg(text, chr(10) order by line) as text from g group by 1, 2, 3, 4, 5)
    select page, top as row, col, coalesce(text, '') as text, case when text is null then 'left' when r < 10 and l - 10 > 10 then 'right' when abs(l - r) < greatest(6.0, 0.05 * (b - a)) and l > 8 then 'center' else 'left' end as align, below from s join n using (page, top, col)""")
def ruled_zone_cells(spark, d):
    """Words of whole pages in the cells between rules."""
    return zones.ruled_cells(boxes(spark, d), rule_boxes(spark, d))


@query(f"""with recursive b as materialized (select * from {BOXES} where length(t) % 4 <> 3),
    r as (select page, x0, max(x1) over (partition by page order by x0, x1, id rows between unbounded preceding and 1 preceding) as reach from b),
    k as materialized (select page, list(round_even((x0 + reach) / 2, 0)) as cuts from r where x0 - reach > 18 group by 1),
    w as materialized (select b.*, round_even(y0 / 3, 0) as ln, len(list_filter(coalesce(cuts, []), lambda x: b.x0 >= x - 2)) as col from b left join k using (page)),
    f as (select page, ln, list_sort(list(distinct col)) as have, min_by(struct_pack(a := y0, z := y1), (x0, id)) as first from w group by 1, 2),
    l as materialized (select *, coalesce(first.a - (lag(first) over o).a <= 1.7 * ((lag(first) over o).z - (lag(first) over o).a), false) as close, row_number() over o as i from f window o as (partition by page order by ln)),
    h as (select page, i, ln, have, ln as head from l where i = 1
      union all select l.page, l.i, l.ln, case when l.close and len(l.have) < len(h.have) and len(list_filter(l.have, lambda x: not list_contains(h.have, x))) = 0 then h.have else l.have end,
        case when l.close and len(l.have) < len(h.have) and len(list_filter(l.have, lambda x: not list_contains(h.have, x))) = 0 then h.head else l.ln end from h join l on l.page = h.page and l.i = h.i + 1),
    n as (select page, ln, cast(dense_rank() over (partition by page order by head) - 1 as integer) as row from h),
    g as (select page, row, col, ln, string_agg(t, ' ' order by x0, id) as text from w join n using (page, ln) group by all)
    select page, row, cast(col as integer) as col, string_agg(text, chr(10) order by ln) as text from g group by all""")
def spaced_zone_cells(spark, d):
    """Words of whole pages in the columns between wide spaces."""
    return zones.spaced_cells(boxes(spark, d).where(F.length("t") % 4 != 3))


# -- content of tree elements (the words of a document hang in a tree: each under half of its number, or in a chain under the word before)

_NODES = "(select doc_id as doc, cast(unnest(range(len(w))) as integer) as node, unnest(w) as t from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents where text is not null))"


@query(f"""with recursive n as materialized (select doc, node, case when doc % 3 = 0 then case when node > 0 then node - 1 end when node > 0 then node // 2 end as parent, (length(t) * 5 + node) % 7 = 0 as holds, t from {_NODES}),
    u as (select doc, node as leaf, node as spot, parent, holds from n union all select u.doc, u.leaf, n.node, n.parent, n.holds from u join n on u.doc = n.doc and u.parent = n.node where not u.holds),
    h as (select doc, leaf, spot from u where holds)
    select h.doc, spot as node, count(*) as n, string_agg(t, ' ' order by (n.node * 31) % 5, n.node) as text from h join n on h.doc = n.doc and h.leaf = n.node group by 1, 2""")
def tree_contents(spark, d):
    """Words gathered under the elements that hold content, by page and number."""
    words = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("node", "t"))
    k = F.col("node")
    nodes = words.withColumn("parent", F.when(k > 0, F.when(F.col("doc") % 3 == 0, k - 1).otherwise(F.floor(k / 2).cast("int"))))
    leaves = words.select("doc", ((k * 31) % 5).alias("page"), k.alias("mcid"), "node", F.col("t").alias("text"))
    return tree.gathered(nodes, leaves, (F.length("t") * 5 + k) % 7 == 0)


# -- the model of pages (segments are blocks, a dozen to a page; headers repeat but for some pages)

_PAGED = f"(select doc, seg // 12 + 1 as page, 60.0 + length(text) % 4 * 6 as x0, 60.0 + length(text) % 4 * 6 + least(length(text) * 4, 420) as x1, 90.0 + seg % 12 * 40 + length(text) % 7 as top, 104.0 + seg % 12 * 40 + length(text) % 7 as bottom, length(text) as chars, text from {SEG} where text <> '')"


@query(f"""with b as materialized (select * from {_PAGED}),
    k as (select doc, page, case when page = 1 and doc % 3 = 0 then 'title' when page between 2 and 3 and doc % 4 = 0 then 'contents' when doc % 5 = 0 then '' else 'manual' end as key from (select distinct doc, page from b)),
    x as (select doc, min(x) as shared from (select doc, round_even(x0, 0) as x from b group by 1, 2 having count(*) >= 3) group by 1),
    h as (select doc, median(x0) as low from (select doc, x0, row_number() over (partition by doc order by x0) - 1 as r, count(*) over (partition by doc) as n from b) where r < greatest(1, n // 2) group by 1),
    s as (select doc, 595.0 - max(x1) as right_ from b group by 1),
    p as materialized (select doc, page, min(top) as first, max(bottom) as last, sum(chars) as chars from b group by 1, 2),
    t as (select doc, list(first order by first)[count(*) // 5 + 1] as top, list(last order by last)[cast(floor(count(*) * 0.8) as bigint) + 1] as bottom from p group by 1),
    u as (select doc, list(chars order by chars)[count(*) // 2 + 1] as usual from p where page > 1 group by 1),
    y as (select doc, max_by(key, (n, key)) as body from (select doc, key, count(*) as n from k group by 1, 2) group by 1),
    z as (select doc, max(page) as pages, bool_and(key = body) filter (page = 1) as own, min(page) filter (page > 1 and key = body) as back, any_value(body) as body from k join y using (doc) group by 1),
    a as (select *, coalesce(back, pages + 1) - 2 as before from z left join u using (doc) left join (select doc, chars as c1 from p where page = 1) using (doc)),
    m as (select *, pages > 1 and (coalesce(usual > 0 and coalesce(c1, 0) < 0.4 * usual, false) or body <> '' and not coalesce(own, false)) as cover, case when body <> '' and before between 1 and greatest(3, 0.15 * pages) then before else 0 end as front from a)
    select doc, pages, coalesce(shared, low) as left_, right_, top, bottom, cast(usual as bigint) as usual, cover, cast(front as integer) as front, cast(case when front > 0 then front + 2 when cover then 2 else 1 end as integer) as first_page
    from m join s using (doc) join h using (doc) join t using (doc) left join x using (doc)""")
def page_models(spark, d):
    rows = seg(spark, d).where("text <> ''")
    n, q = F.length("text"), F.col("seg")
    x0, y = 60.0 + n % 4 * 6, 90.0 + q % 12 * 40 + n % 7
    b = rows.select("doc", (F.floor(q / 12) + 1).alias("page"), x0.alias("x0"), (x0 + F.least(n * 4, F.lit(420))).alias("x1"), y.alias("top"), (y + 14).alias("bottom"), n.alias("chars"))
    p, k = F.col("page"), F.col("doc")
    key = F.when((p == 1) & (k % 3 == 0), "title").when(p.between(2, 3) & (k % 4 == 0), "contents").when(k % 5 == 0, "").otherwise("manual")
    out = zones.page_model(b, 595.0, b.select("doc", "page").distinct().withColumn("key", key))
    return out.withColumnsRenamed({"left": "left_", "right": "right_"})
