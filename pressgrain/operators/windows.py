"""Ordered operators: durations, islands, intervals, repeats and order checks.

A run, a source or a user may hold a large share of all rows, so none of these sends a whole key to one task: rows
are split into ordered buckets and only edge values cross them (see `pressgrain.scale`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pressgrain.operators.ranking import top_k
from pressgrain.scale import neighbour

MIN_STAGE_MS = 200


def stage_durations(log_rows: DataFrame, runs: DataFrame, slice_ms: int = 60_000, max_ms: int | None = None) -> DataFrame:
    """Time from each stage event to the next one of its run, the last one to the run's end; at least 200 ms.

    `max_ms` leaves longer durations out.
    """
    stages = log_rows.where(F.col("stage").isNotNull()).select("run_id", "event_id", "stage", "t")
    bucket = F.floor(F.col("t") / slice_ms)
    rows = neighbour(stages, ["run_id"], ["t", "event_id"], bucket, ["t"], "next")
    rows = rows.join(runs.select("run_id", "duration_ms"), "run_id")
    dur = F.greatest(F.lit(MIN_STAGE_MS), F.coalesce(F.col("next.t"), F.col("duration_ms")) - F.col("t"))
    out = rows.select("run_id", "event_id", "stage", "t", dur.alias("dur"))
    out = out.where(F.col("dur") >= MIN_STAGE_MS)
    return out if max_ms is None else out.where(F.col("dur") <= max_ms)


def newest_n(df: DataFrame, order: Sequence[Column], n: int, key: Sequence[str] = ()) -> DataFrame:
    """Newest `n` rows, overall or per key."""
    if key:
        return top_k(df, key, order, n, "__rank").drop("__rank")
    return df.orderBy(*order).limit(n)


def first_seen(df: DataFrame, group: Sequence[str], key: str, pos: str) -> DataFrame:
    """First row of every key within its group, by position."""
    rest = [c for c in df.columns if c not in (*group, key)]
    first = df.groupBy(*group, key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("__row"))
    return first.select(*group, key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, state: str) -> DataFrame:
    """Add `island`: the number of the run of equal neighbouring `state` values a row belongs to, from 1.

    Changes are counted inside each (group, bucket); one summary row per bucket with its first and last state and its
    number of changes then gives the islands that ended before the bucket.
    """
    keys = [*group, "__b"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(state)).over(inside)
    changed = before.isNotNull() & ~before[state].eqNullSafe(F.col(state))
    rows = df.withColumn("__b", bucket).withColumn("__c", changed.cast("long"))
    rows = rows.withColumn("__local", F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    position = F.struct(*order)
    edges = rows.groupBy(*keys).agg(F.max("__local").alias("__n"), F.min_by(F.struct(state), position).alias("__first"),
                                    F.max_by(F.struct(state), position).alias("__last"))
    across = Window.partitionBy(*group).orderBy("__b")
    prev = F.lag("__last").over(across)
    starts = (prev.isNull() | ~prev[state].eqNullSafe(F.col(f"__first.{state}"))).cast("long")
    edges = edges.select(*keys, "__n", starts.alias("__start"))
    done = F.coalesce(F.sum(F.col("__n") + F.col("__start")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*keys, (done + F.col("__start")).alias("__base"))
    joined = rows.join(edges, keys, "left")
    return joined.withColumn("island", F.col("__base") + F.col("__local")).drop("__b", "__c", "__local", "__base")


def consecutive_runs(df: DataFrame, group: Sequence[str], pos: str, flag: str, k: int, slice_rows: int = 10_000) -> DataFrame:
    """Runs of at least `k` neighbouring rows where the flag holds: start, end and length."""
    rows = islands(df, group, [pos], F.floor(F.col(pos) / slice_rows), flag).where(F.col(flag))
    runs = rows.groupBy(*group, "island").agg(F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= k).drop("island")


def last_event(log_rows: DataFrame, events: Sequence[str]) -> DataFrame:
    """Last time and id of each event kind per run, and the last event of any kind after the last of the first kind."""
    position = F.struct("t", "event_id")
    rows = log_rows.where(F.col("event").isin(*events))
    return rows.groupBy("run_id", "event").agg(F.max("t").alias("last_t"), F.max_by("event_id", position).alias("last_id"))


def coalesce_pulses(log_rows: DataFrame, slice_ms: int = 60_000) -> DataFrame:
    """Neighbouring pulses of the same phase merged: first time as `since`, last time and counts kept."""
    rows = islands(log_rows, ["run_id"], ["t", "event_id"], F.floor(F.col("t") / slice_ms), "phase")
    position = F.struct("t", "event_id")
    return rows.groupBy("run_id", "island").agg(
        F.first("phase").alias("phase"), F.min("t").alias("since"), F.max("t").alias("t"),
        F.max_by("chars", position).alias("chars"), F.count(F.lit(1)).alias("pulses"))


def incident_intervals(probes: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, down: str) -> DataFrame:
    """One row per incident: from the first down probe to the first up probe after it, open if there is none."""
    at = order[0]
    rows = neighbour(probes, group, order, bucket, [down], "__prev", forward=False)
    changes = rows.where((F.col(down) & ~F.coalesce(F.col(f"__prev.{down}"), F.lit(False)))
                         | (~F.col(down) & F.coalesce(F.col(f"__prev.{down}"), F.lit(False)))).drop("__prev")
    paired = neighbour(changes, group, order, bucket, [at], "__next")
    return paired.where(F.col(down)).select(*group, F.col(at).alias("started_at"), F.col(f"__next.{at}").alias("resolved_at"))


def repeated_keys(df: DataFrame, group: Sequence[str], pos: str, key: str) -> DataFrame:
    """Rows whose key already occurred earlier in their group, with the first position."""
    first = df.groupBy(*group, key).agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(first, [*group, key]).where(F.col(pos) > F.col("first_pos"))


def order_violations(df: DataFrame, group: Sequence[str], pos: str, value: str, slice_rows: int = 10_000) -> DataFrame:
    """Rows whose value does not exceed the previous one of their group."""
    rows = neighbour(df, group, [pos], F.floor(F.col(pos) / slice_rows), [value], "__prev", forward=False)
    prev = F.col(f"__prev.{value}")
    return rows.where(F.col(value) <= prev).select(*group, pos, value, prev.alias("previous"))


def series_quality(df: DataFrame, group: Sequence[str], pos: str, label: str, value: str, unit: str) -> DataFrame:
    """Issues per series: repeated labels, mixed units, no ascending labels, shares off 100, rising funnel."""
    rows = neighbour(df, group, [pos], F.floor(F.col(pos) / 10_000), [label, value], "__prev", forward=False)
    back = F.col(f"__prev.{label}") >= F.col(label)
    up = F.col(value) > F.col(f"__prev.{value}")
    # One distinct count only: a second one would write each row three times into the aggregation.
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("labels"), F.coalesce(F.min(unit) < F.max(unit), F.lit(False)).alias("mixed"),
        F.sum(value).alias("total"), F.max(F.coalesce(back, F.lit(False))).alias("back"), F.max(F.coalesce(up, F.lit(False))).alias("up"))
    issues = F.array_compact(F.array(
        F.when(F.col("labels") < F.col("n"), "labels_repeat"), F.when(F.col("mixed"), "units_differ"),
        F.when(F.col("back"), "not_ascending"), F.when(~F.col("total").between(99, 101), "shares_not_100"),
        F.when(F.col("up"), "funnel_rises")))
    return stats.select(*group, "n", issues.alias("issues"))


def waterfall_ok(start: Column, delta: Column, end: Column, signed: Column) -> Column:
    """Start and change add up to the end within one percent; an unsigned change may also be a decrease."""
    tolerance = F.greatest(F.lit(0.01), F.abs(start) * 0.01)
    plain = F.abs(start + delta - end)
    gap = F.when(signed, plain).otherwise(F.least(plain, F.abs(start - F.abs(delta) - end)))
    return gap <= tolerance


def new_today(ts: Column, as_of: Column) -> Column:
    return F.to_date(ts) == F.to_date(as_of)


def backlog(jobs: DataFrame, as_of: Column, limit: int, max_attempts: int = 3, stale_hours: int = 2, cap: int | None = None) -> DataFrame:
    """Claimable jobs in order: queued with attempts left, or running and stale; a `cap` clamps the limit."""
    stale = F.col("updated_at") < as_of - F.expr(f"interval {stale_hours} hours")
    claimable = ((F.col("status") == "queued") & (F.col("attempts") < max_attempts)) | ((F.col("status") == "running") & stale)
    return jobs.where(claimable).orderBy("available_at", "job_id").limit(max(1, limit) if cap is None else clamp_limit(limit, 12, cap))


def clamp_limit(n: int | None, default: int, cap: int) -> int:
    return max(1, min(default if n is None else n, cap))


def retention(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than the retention period."""
    return df.where(F.col(ts) >= as_of - F.expr(f"interval {days} days"))
