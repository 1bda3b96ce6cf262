"""Queries over jobs, users, edits, dictionaries and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import dictionary, memory, order, quality, state
from textloom.plans.registry import Registry
from textloom.sources.tables import table
from textloom.streaming import events as stream

query = Registry()

NOW = "timestamp '1998-08-02 00:00:00'"


def jobs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("version"), F.floor(F.col("o_totalprice") / 1000).alias("segments")
    )


JOBS = "(select o_orderkey as job, o_custkey as owner, o_orderstatus as status, o_orderdate as created, o_orderpriority as version, cast(floor(o_totalprice / 1000) as bigint) as segments from orders)"


def edits(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("doc"), F.col("l_linenumber").alias("seg"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("created"), F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after")
    )


EDITS = "(select l_orderkey as job, l_partkey as doc, l_linenumber as seg, l_suppkey as author, l_shipdate as created, l_returnflag as before, l_linestatus as after from lineitem)"


@query("""select o_custkey as k, o_orderpriority as project, tgt, approved from (select *, o_orderkey as tgt, o_orderstatus = 'F' as approved, row_number() over (partition by o_custkey, o_orderpriority order by o_orderstatus = 'F' desc, o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def tm_priority_last_wins(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("project"), (F.col("o_orderstatus") == "F").alias("approved"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("tgt"))
    return memory.last_wins(rows, ["k", "project"], ["approved", "created", "tgt"], ["tgt"]).select("k", "project", "tgt", "approved")


@query(f"select doc, author, job, seg, after from (select *, row_number() over (partition by doc, author order by created desc, job desc, seg desc, after desc) as r from {EDITS}) where r = 1")
def tm_upsert_latest(spark, d):
    return memory.upserted(edits(spark, d), ["doc", "author"], ["created", "job", "seg", "after"], ["after"]).select("doc", "author", "job", "seg", "after")


@query("""with c as (select l_partkey, min(l_orderkey * 10 + l_linenumber) as a from lineitem where l_returnflag = 'R' group by 1)
    select l_partkey as doc, l_orderkey * 10 + l_linenumber as id, case when a is null then 'draft' when a = l_orderkey * 10 + l_linenumber then 'approved' else 'rejected' end as status from lineitem left join c using (l_partkey)""")
def tm_approve_rejects_rivals(spark, d):
    rows = edits(spark, d).withColumn("id", F.col("job") * 10 + F.col("seg"))
    return memory.approved(rows, ["doc"], "before = 'R'", "id").select("doc", "id", "status")


_RATES = f"with e as (select job, count(distinct (doc, seg)) as n from {EDITS} group by job)"


@query(_RATES + f" select strftime(created, '%Y-%m') as month, count(*) as jobs, cast(sum(segments) as bigint) as segments, cast(sum(coalesce(n, 0)) as bigint) as edited, round(sum(coalesce(n, 0)) / greatest(sum(segments), 1), 6) as rate from {JOBS} left join e using (job) group by 1")
def quality_by_month(spark, d):
    return quality.rates(jobs(spark, d), edits(spark, d), F.date_format("created", "yyyy-MM"), "month")


@query(_RATES + f" select version, count(*) as jobs, cast(sum(segments) as bigint) as segments, cast(sum(coalesce(n, 0)) as bigint) as edited, round(sum(coalesce(n, 0)) / greatest(sum(segments), 1), 6) as rate from {JOBS} left join e using (job) group by 1")
def quality_by_version(spark, d):
    return quality.rates(jobs(spark, d), edits(spark, d), F.col("version"), "version")


@query(f"select job, count(distinct (doc, seg)) as n from {EDITS} group by job")
def edits_distinct_per_job(spark, d):
    return quality.distinct_edits(edits(spark, d))


@query("select p_brand as layer, count(*) as n from part group by 1")
def glossary_counts_by_layer(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.count("*").alias("n"))


_KIND = """(select source, case when n_chars % 11 = 0 then 'edited' when quality = 0 then 'error' when toxic = 1 then 'suspect' when n_chars % 7 = 0 then 'auto' when n_chars % 5 = 0 then 'term' else 'ok' end as kind
    from documents left join labels using (doc_id))"""


@query(f"select source, kind, coalesce(n, 0) as n from (select distinct source from documents) cross join (select unnest(['edited', 'error', 'suspect', 'auto', 'term', 'ok']) as kind) left join (select source, kind, count(*) as n from {_KIND} group by 1, 2) using (source, kind)")
def class_counts_zero_filled(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = quality.row_class(F.col("n_chars") % 11 == 0, F.when(yes(F.col("quality") == 0), 1).otherwise(0), yes(F.col("toxic") == 1), F.col("n_chars") % 7 == 0, F.col("n_chars") % 5 == 0)
    return quality.class_counts(rows.select("source", kind.alias("kind")), "source").withColumn("n", F.col("n").cast("long"))


@query(f"select version, count(*) as rows, cast(sum(case when status = 'P' then 0 else 1 end) as bigint) as translated, cast(sum(case when segments % 3 > 0 then 1 else 0 end) as bigint) as with_issues, cast(sum(case when status = 'O' then 1 else 0 end) as bigint) as suspicious from {JOBS} group by 1")
def job_summary(spark, d):
    rows = jobs(spark, d).select("version", (F.col("status") == "P").alias("copied"), (F.col("segments") % 3).alias("issues"), (F.col("status") == "O").alias("suspicious"))
    return quality.summary(rows, "version")


@query("""with i as (select quality as label, (case when text = upper(text) then 1 else 0 end) + (case when contains(text, '|') then 1 else 0 end) + (case when contains(text, '***') then 1 else 0 end) + (case when contains(text, '!!') then 1 else 0 end) as votes
      from documents join labels using (doc_id)) select cast(threshold as integer) as threshold, label, cast(sum(case when votes >= threshold then 1 else 0 end) as bigint) as hits, count(*) as total from i cross join (select unnest(range(1, 4)) as threshold) group by 1, 2""")
def vote_thresholds(spark, d):
    t = F.col("text")
    flag = lambda c: F.when(c, 1).otherwise(0)
    votes = flag(t == F.upper(t)) + flag(t.contains("|")) + flag(t.contains("***")) + flag(t.contains("!!"))
    items = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), votes.alias("votes"))
    return quality.vote_thresholds(items, 3)


_DEC = "(select user_id as key, ts, event_id as id, case event_type when 'purchase' then 'accept' when 'error' then 'reject' else 'edit' end as action, event_type || '-' || event_id as tgt from events)"


@query(f"select key, arg_max(action, (ts, id)) as state, arg_max(tgt, (ts, id)) filter (where action = 'accept') as tgt, cast(sum(case when action = 'accept' then 1 else 0 end) as bigint) as version from {_DEC} group by key")
def dictionary_versions(spark, d):
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("edit")
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), action.alias("action"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("tgt"))
    return dictionary.versions(rows)


@query("select p_name, p_brand, p_partkey from part where p_name ilike '%an%' or p_brand ilike '%an%' order by lower(p_name), p_name, p_partkey limit 100")
def dictionary_search(spark, d):
    rows = table(spark, d, "part").where(F.col("p_name").ilike("%an%") | F.col("p_brand").ilike("%an%"))
    return quality.ranked_page(rows.select("p_name", "p_brand", "p_partkey"), [F.lower("p_name"), F.col("p_name"), F.col("p_partkey")])


@query(f"select job, coalesce(nullif(c_name, ''), cast(c_custkey as varchar)) as owner_name, created, status from {JOBS} j join customer on owner = c_custkey order by created desc, job desc limit 50")
def jobs_with_owner(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.coalesce(F.nullif("c_name", F.lit("")), F.col("owner").cast("string")).alias("owner_name"))
    return quality.ranked_page(jobs(spark, d).join(users, "owner").select("job", "owner_name", "created", "status"), [F.desc("created"), F.desc("job")], size=50)


@query(f"select job, version, cast(row_number() over (partition by version order by created, job) as integer) as position from {JOBS} where status = 'O'")
def queue_positions(spark, d):
    return state.queue_positions(jobs(spark, d).where("status = 'O'"), "version", ["created", "job"]).select("job", "version", "position")


@query(f"""select owner, created, job from (select *, row_number() over (partition by owner order by created, job) as r from {JOBS} where status = 'O' and owner not in (select owner from {JOBS} where status = 'P')) where r = 1 order by created, job limit 20""")
def queue_admission(spark, d):
    rows = jobs(spark, d)
    return state.admitted(rows.where("status = 'O'"), rows.where("status = 'P'"), "owner", ["created", "job"], 20)


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, count(*) as n_events from events group by 1")
def job_latest_state(spark, d):
    return state.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


_STEP = "case " + " ".join(f"when s = '{a}|{b}' then '{c}'" for (a, b), c in state.TRANSITIONS.items()) + " else string_split(s, '|')[1] end"


@query(f"""with recursive e as (select user_id, ['start', 'finish', 'fail', 'cancel', 'retry'][event_id % 5 + 1] as action, row_number() over (partition by user_id order by event_id) as k from events),
    r as (select user_id, cast(0 as bigint) as k, 'queued' as state from (select distinct user_id from events) union all select user_id, k, {_STEP} from (select r.user_id, e.k, r.state || '|' || e.action as s from r join e on e.user_id = r.user_id and e.k = r.k + 1))
    select user_id, max_by(state, k) as state, cast(max(k) as int) as n from r group by 1""")
def job_replay(spark, d):
    action = F.element_at(F.array(*[F.lit(a) for a in ("start", "finish", "fail", "cancel", "retry")]), (F.col("event_id") % 5 + 1).cast("int"))
    return state.replayed(table(spark, d, "events").withColumn("action", action), "user_id", "event_id", "action")


@query("""select event_id, user_id, recent, recent >= 5 as blocked from (select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row) as recent from events where event_type = 'click')""")
def login_throttle(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'")
    return state.throttled(rows, "user_id", "ts", seconds=86400).select("event_id", "user_id", "recent", "blocked")


@query("select event_id, user_id from events where ts < (select max(ts) from events) - interval 14 day")
def ttl_expired(spark, d):
    rows = table(spark, d, "events")
    newest = rows.agg(F.max("ts").alias("now"))
    return state.expired(rows.crossJoin(F.broadcast(newest)), "ts", 14, F.col("now")).select("event_id", "user_id")


@query(f"select job, owner, r <= 14 as kept from (select *, row_number() over (partition by owner order by created desc, job desc) as r from {JOBS})")
def keep_newest_k(spark, d):
    return order.newest(jobs(spark, d), "owner", [F.desc("created"), F.desc("job")], 14).select("job", "owner", "kept")


@query(f"select doc, seg, arg_min(before, (created, job, author)) as before, arg_max(after, (created, job, author)) as after, count(*) as n_edits from (select distinct * from {EDITS}) group by 1, 2")
def pending_first_last(spark, d):
    return memory.pending(edits(spark, d).distinct(), ["doc", "seg"], ["created", "job", "author"])


@query("select event_type, count(*) as n, round(avg(value), 4) as mean from events group by 1")
def event_type_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("select event_type, quantile_disc(value, 0.5) as lower, (list(value order by value))[count(value) // 2 + 1] as upper, round((quantile_disc(value, 0.5) + (list(value order by value))[count(value) // 2 + 1]) / 2, 6) as middle from events group by 1")
def upper_lower_medians(spark, d):
    return order.medians(table(spark, d, "events"), "event_type", "value")


@query("select l_shipmode, l_quantity, cast(weight as bigint) as weight from (select *, row_number() over (partition by l_shipmode order by weight desc, l_quantity) as r from (select l_returnflag as l_shipmode, l_quantity, sum(l_linenumber) as weight from lineitem group by 1, 2)) where r = 1")
def weighted_mode(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_returnflag"))
    return order.weighted_mode(rows, "l_shipmode", "l_quantity", "l_linenumber")


@query("with s as (select l_returnflag as k, l_quantity as q, sum(l_linenumber) as w from lineitem group by 1, 2), r as (select *, sum(w) over (partition by k order by q) as run, sum(w) over (partition by k) as total from s) select k as l_returnflag, min(q) as median from r where 2 * run >= total group by 1")
def weighted_median(spark, d):
    return order.weighted_median(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber")


@query("""with m as (select event_type, value, case when value - lag(value) over (partition by event_type order by value) > 2 then 1 else 0 end as b from events),
    i as (select event_type, value, sum(b) over (partition by event_type order by value rows unbounded preceding) as island from m)
    select event_type, cast(island as bigint) as island, count(*) as n, min(value) as low, max(value) as high, round(avg(value), 6) as center from i group by 1, 2""")
def gap_clusters(spark, d):
    return order.gap_clusters(table(spark, d, "events"), "event_type", "value", 2.0)


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as n_keys from events")
def json_props(spark, d):
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), 0).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    out = stream.windowed(table(spark, d, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select c_custkey, c_name, regexp_extract(c_name, '[0-9]+') as digits, regexp_replace(c_name, '[0-9]+', '#', 'g') as sig from customer")
def digit_signatures(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", F.regexp_extract("c_name", "[0-9]+", 0).alias("digits"), X.digit_signature(F.col("c_name")).alias("sig"))


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)")
def suppliers_without_edits(spark, d):
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, d, "supplier").select("s_suppkey", "s_name").join(bad, "s_suppkey", "left_anti")


@query("select n_name, r_name, count(*) as users from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def users_by_region(spark, d):
    users = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"))
    return users.join(table(spark, d, "nation"), "n_nationkey").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "users")


_STATUS = "case when status = 'P' then 'queued' when status = 'F' then case when segments % 2 = 0 then 'done' else 'cancelled' end else status end"


@query(f"select job, {_STATUS} as status from {JOBS}")
def crash_recovery(spark, d):
    mapped = F.when(F.col("status") == "P", "running").when(F.col("status") == "F", "cancelling").otherwise(F.col("status"))
    return jobs(spark, d).select("job", state.recovered(mapped, F.col("segments") % 2 == 0).alias("status"))


@query(f"select job, round(20 + 60 * (job % 50) / greatest(segments, 1), 2) as pct from {JOBS}")
def progress_percent(spark, d):
    return jobs(spark, d).select("job", state.progress(F.lit(60), F.col("job") % 50, F.col("segments"), F.lit(20)).alias("pct"))
