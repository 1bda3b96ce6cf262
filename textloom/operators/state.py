"""Jobs and events: latest states, admission, throttling, expiry, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.scratch import stored

#: Transitions of a job (fixed values).
TRANSITIONS = {("queued", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelling", ("cancelling", "finish"): "cancelled", ("failed", "retry"): "queued", ("cancelled", "retry"): "queued"}
THROTTLE_SECONDS, THROTTLE_LIMIT = 600, 5


def latest(events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    o = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, o).alias(c) for c in keep], F.count("*").alias("n_events"))


def stepped(state: Column, action: Column) -> Column:
    """The state after an action; actions that do not fit change nothing."""
    out = state
    for (s, a), to in TRANSITIONS.items():
        out = F.when((state == s) & (action == a), to).otherwise(out)
    return out


def replayed(events: DataFrame, key: str, order: str, action: str, start: str = "queued") -> DataFrame:
    """Final state of each job after its actions in order: (key, state, n).

    Ranges of the ordered events are folded to maps from each state to the one after them; maps compose, so a job of many events is many ranges.
    """
    states = sorted({s for s, _ in TRANSITIONS} | {*TRANSITIONS.values(), start})
    ranged = events.select(key, order, action).repartitionByRange(key, order, action).withColumn("chunk", F.spark_partition_id())
    lists = ranged.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, action))).alias("a"))
    same = F.struct(*[F.lit(s).alias(s) for s in states])
    folded = F.aggregate("a", same, lambda acc, x: F.struct(*[stepped(acc[s], x[action]).alias(s) for s in states]))
    maps = lists.select(key, F.struct("chunk", folded.alias("to"), F.size("a").alias("n")).alias("m")).groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))

    def through(state: Column, m: Column) -> Column:
        out = state
        for s in states:
            out = F.when(state == s, m["to"][s]).otherwise(out)
        return out

    n = F.aggregate("m", F.lit(0), lambda acc, m: acc + m["n"])
    return maps.select(key, F.aggregate("m", F.lit(start), through).alias("state"), n.alias("n"))


def recovered(state: Column, edit_mode: Column) -> Column:
    """State after a crash: running goes back to the queue, cancelling ends as done (edit mode) or cancelled."""
    return F.when(state == "running", "queued").when(state == "cancelling", F.when(edit_mode, "done").otherwise("cancelled")).otherwise(state)


def throttled(failures: DataFrame, key: str, ts: str, seconds: int = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT) -> DataFrame:
    """Failures within the sliding window before and with each one; blocked at ``limit``."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return failures.withColumn("recent", F.count("*").over(w)).withColumn("blocked", F.col("recent") >= limit)


def queue_positions(jobs: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Adds ``position`` in the queue of each part, from 1: the number in the order of all parts less what lies before the part."""
    rows = numbered(jobs, [part, *order], "number__")
    first = rows.groupBy(part).agg(F.min("number__").alias("first__"))
    return rows.join(first, part).withColumn("position", (F.col("number__") - F.col("first__") + 1).cast("int")).drop("number__", "first__")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's number in the whole order, from 1: numbers within ranges plus the ranges' offsets, so no task meets all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    ranged = stored(ranged.withColumn("range__", F.shiftright(own, 33)).withColumn("own__", own.bitwiseAND(F.lit(2**33 - 1))), "numbered")
    sizes, before, at = ranged.groupBy("range__").agg(F.count("*").alias("n")).orderBy("range__").collect(), [], 0
    for r in sizes:
        before.append((r["range__"], at))
        at += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "range__ long, before__ long")
    return ranged.join(F.broadcast(offsets), "range__").withColumn(name, F.col("before__") + F.col("own__") + 1).drop("range__", "own__", "before__")


def admitted(queued: DataFrame, running: DataFrame, owner: str, order: list[str], cap: int) -> DataFrame:
    """The next jobs: one for each owner without a running one, oldest first, ``cap`` in all (the scheduler's limit)."""
    free = queued.join(running.select(owner).distinct(), owner, "left_anti")
    first = free.groupBy(owner).agg(F.min(F.struct(*order)).alias("m")).select(owner, *[F.col(f"m.{c}").alias(c) for c in order])
    return first.orderBy(*order).limit(cap)


def expired(rows: DataFrame, ts: str, days: float, now: Column) -> DataFrame:
    """Rows older than ``days`` (0 keeps all)."""
    return rows.where(F.lit(days > 0) & (F.col(ts) < now - F.expr(f"make_dt_interval({int(days)})")))


def progress(stage_weight: Column, done: Column, total: Column, before: Column) -> Column:
    return F.round(before + stage_weight * done / F.greatest(total, F.lit(1)), 2)
