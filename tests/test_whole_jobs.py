"""Queue, new ids and replay over all rows."""

import random

from textloom.operators import state


def test_one_job_of_many_events_is_replayed_in_ranges(spark):
    r = random.Random(5)
    rows = [(1 if k % 10 else k % 7, k, r.choice(["start", "finish", "fail", "cancel", "retry"])) for k in range(3000)]
    r.shuffle(rows)
    brute = {}
    for job, _, a in sorted(rows):
        s, n = brute.get(job, ("queued", 0))
        brute[job] = (state.TRANSITIONS.get((s, a), s), n + 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = state.replayed(spark.createDataFrame(rows, "job int, o int, a string"), "job", "o", "a")
        assert {x.job: (x.state, x.n) for x in out.collect()} == brute
        plan = out._jdf.queryExecution().toString()
        assert "rangepartitioning(job" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_all_rows(spark):
    rows = spark.range(5000, numPartitions=5).selectExpr("id * 7919 % 5003 as k", "id")
    found = [(r.k, r.n) for r in state.numbered(rows, ["k"], "n").collect()]
    assert sorted(found) == [(k, i + 1) for i, k in enumerate(sorted(x[0] for x in found))]
