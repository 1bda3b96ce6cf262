"""Queries over boxes on pages; the boxes are derived from words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import geometry, order
from textloom.plans.registry import Registry
from textloom.sources.tables import page_lines, table

query = Registry()


def page_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page"), "text")


def boxes(spark, d):
    return geometry.token_boxes(page_texts(spark, d))


BOXES = """(select page, id, id // 8 as line, t, cast((id % 8) * 60.0 + (length(t) * 7) % 11 as double) as x0, cast((id // 8) * 12.0 + length(t) % 3 as double) as y0, cast((id % 8) * 60.0 + (length(t) * 7) % 11 + length(t) * 6.0 as double) as x1,
    cast((id // 8) * 12.0 + length(t) % 3 + 10.0 as double) as y1 from (select page, unnest(range(len(w))) as id, unnest(w) as t from (select doc_id as page, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from documents where text is not null)))"""


@query(f"""with b as {BOXES}, p as (select a.page, a.id as a, b.id as b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as area, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as smaller
    from (select *, line + unnest(range(6)) as band from b) a join b b on a.page = b.page and a.band = b.line and a.id < b.id and b.id < a.id + 40 and least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0)) select page, cast(a as integer) as a, cast(b as integer) as b, round(area, 6) as area from p where area > 0.25 * smaller""")
def box_overlaps(spark, d):
    return geometry.overlaps(boxes(spark, d))


_LINES = "(select page, line as id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from b group by 1, 2)"


@query(f"""with b as {BOXES}, l as {_LINES}, m as (select b.page, b.id, l.id as line, round((least(b.x1, l.x1) - greatest(b.x0, l.x0)) * (least(b.y1, l.y1) - greatest(b.y0, l.y0)), 6) as area from b join l on b.page = l.page and abs(b.line - l.id) <= 2
      and least(b.x1, l.x1) > greatest(b.x0, l.x0) and least(b.y1, l.y1) - greatest(b.y0, l.y0) > 0.4 * (b.y1 - b.y0))
    select page, cast(id as integer) as id, line, area from (select *, row_number() over (partition by page, id order by area desc, line) as r from m) where r = 1""")
def spatial_argmax(spark, d):
    b = boxes(spark, d)
    lines = geometry.unions(b, ["page", "line"]).withColumnRenamed("line", "id").drop("n")
    return geometry.best_line(b, lines)


@query(f"""with b as {BOXES}, f as (select *, case when x0 - lag(x1) over (partition by page, line order by x0, id) > 30 then 1 else 0 end as far from b), i as (select *, sum(far) over (partition by page, line order by x0, id rows unbounded preceding) as island from f)
    select page, line, cast(island as bigint) as island, count(*) as n, min(x0) as x0, max(x1) as x1, string_agg(t, ' ' order by x0, id) as text from i group by 1, 2, 3""")
def line_islands(spark, d):
    return geometry.line_groups(boxes(spark, d))


@query(f"""with b as {BOXES}, g as (select page, line, lead(x0) over (partition by page, line order by x0, id) - x1 as gap from b), r as (select page, line, list(gap order by gap desc) as g from g where gap is not null group by 1, 2)
    select page, line, round(g[1], 6) as gap, round(coalesce(g[2], 0.0), 6) as second from r where g[1] >= 20 and g[1] >= 1.5 * coalesce(g[2], 0)""")
def widest_gap(spark, d):
    return geometry.widest_gaps(boxes(spark, d), 20.0, 1.5)


@query(f"""with b as {BOXES}, w as (select *, sum(case when x1 - x0 >= 60 then 1 else 0 end) over (partition by page order by y0, x0, id rows unbounded preceding) as band, case when x1 - x0 >= 60 then 0 when x0 < 240 then 1 else 2 end as side from b)
    select page, cast(id as integer) as id, cast(band as bigint) as band, side, cast(row_number() over (partition by page order by band, side, y0, x0, id) as integer) as ord from w""")
def reading_order(spark, d):
    return geometry.reading_order(boxes(spark, d), 240.0, 60.0).select("page", "id", "band", "side", "ord")


@query(f"with b as {BOXES} select page, line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from b group by 1, 2")
def bounding_boxes(spark, d):
    return geometry.unions(boxes(spark, d), ["page", "line"])


@query(f"with b as {BOXES} select page, line, cast(id as integer) as id, round(coalesce(lead(x0) over (partition by page, line order by x0, id), 480.0) - x0, 6) as room from b")
def free_width(spark, d):
    return geometry.free_width(boxes(spark, d), 480.0)


@query(f"with b as {BOXES}, k as (select page, id, length(t) % 3 as label, id - row_number() over (partition by page, length(t) % 3 order by id) as k from b) select page, cast(label as integer) as label, cast(min(id) as integer) as start, count(*) as length from k group by page, label, k")
def list_label_runs(spark, d):
    rows = boxes(spark, d).select("page", "id", F.pmod(F.length("t"), F.lit(3)).alias("label"))
    return order.runs(rows, ["page"], "id", "label")


@query("""with u as (select page_id, cast(regexp_extract(url, '[0-9]+') as integer) as number from pages where regexp_extract(url, '[0-9]+') <> ''),
      o as (select page_id % 10 as doc, case when number % 4 = 0 then number - page_id else page_id % 10 * 3 end as off from u), c as (select doc, off, count(*) as n from o group by 1, 2)
    select doc, off as offset, n, cast(total as bigint) as total from (select *, sum(n) over (partition by doc) as total, row_number() over (partition by doc order by n desc, off) as r from c) where r = 1 and n >= 3 and n >= 0.6 * total""")
def page_offset_mode(spark, d):
    """Printed numbers less page numbers: three quarters of the pages keep their document's offset, the others have the number of their URL."""
    number = F.regexp_extract("url", "[0-9]+", 0)
    rows = table(spark, d, "pages").where(number != "").select("page_id", (F.col("page_id") % 10).alias("doc"), number.cast("int").alias("number"))
    rows = rows.select("doc", F.when(F.col("number") % 4 == 0, F.col("number") - F.col("page_id")).otherwise(F.col("doc") * 3).alias("offset"))
    counts = rows.groupBy("doc", "offset").agg(F.count("*").alias("n"))
    modes = counts.groupBy("doc").agg(F.max_by("offset", F.struct("n", F.negative("offset"))).alias("offset"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return modes.where((F.col("n") >= 3) & (F.col("n") >= 0.6 * F.col("total")))


@query(f"""with recursive b as materialized (select page, id, line, x0, y0, x1, y1 from {BOXES}),
    t as materialized (select a.page, a.id as a, c.id as b from (select *, line + unnest(range(-1, 2)) as near from b) a join b c on a.page = c.page and a.near = c.line and a.id <> c.id and a.x0 <= c.x1 and c.x0 <= a.x1 and a.y0 <= c.y1 and c.y0 <= a.y1),
    r as (select page, id, id as grid from b union select t.page, t.b, min(r.grid) from r join t on r.page = t.page and r.id = t.a where r.grid < t.b group by 1, 2) select page, cast(id as integer) as id, cast(min(grid) as integer) as grid from r group by 1, 2""")
def connected_rules(spark, d):
    rules = boxes(spark, d).select("page", "id", "x0", "y0", "x1", "y1")
    return geometry.grids(rules, reach=0.0)


@query("""with l as (select page_id as page, list_filter(list_transform(string_split_regex(html, '<[^>]*>'), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: x <> '') as t from pages)
    select page, cast(unnest(range(len(t))) as integer) as pos, unnest(t) as text from l""")
def page_blocks(spark, d):
    return page_lines(table(spark, d, "pages"))
