"""Run statistics: duration forecast, pace, silence and remaining time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgrain.operators.dedup import written
from pressgrain.operators.ranking import top_k
from pressgrain.operators.windows import MIN_STAGE_MS
from pressgrain.scale import broadcast_if_small

STAGES = ["lesen", "recherchieren", "modell", "pruefen", "bilder", "fuellen"]
MODEL_STAGE, IMAGE_STAGE = "modell", "bilder"
DURATION_RANGE, IMAGE_RANGE = (8_000, 1_200_000), (2_000, 900_000)


def _half_even(col: Column) -> Column:
    return F.rint(col).cast("long")


def union_stages(stages: DataFrame, images: DataFrame) -> DataFrame:
    return stages.unionByName(images)


def run_stages(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """(run_id, stages): time per stage of each of a few runs, in one pass over their logs.

    A stage lasts to the next one of its run or to the run's end, at least 200 ms; the model stage adds up, of the others
    the longest counts, images last from the first start to the last end. Runs of a pool last 20 minutes at most, so the
    log of one fits a task.
    """
    rows = logs.join(broadcast_if_small(runs.select("run_id", "duration_ms")), "run_id")
    staged = (F.col("event") == "stage") & F.col("stage").isin(*STAGES)
    rows = rows.where(staged | F.col("event").isin("image_start", "images_done")).withColumn("__staged", staged)
    nxt = F.lead("t").over(Window.partitionBy("run_id", "__staged").orderBy("t", "event_id"))
    rows = rows.withColumn("dur", F.when(F.col("__staged"), F.greatest(F.lit(MIN_STAGE_MS), F.coalesce(nxt, F.col("duration_ms")) - F.col("t"))))
    times = {s: (F.sum if s == MODEL_STAGE else F.max)(F.when(F.col("stage") == s, F.col("dur"))) for s in STAGES if s != IMAGE_STAGE}
    image = F.max(F.when(F.col("event") == "images_done", F.col("t"))) - F.min(F.when(F.col("event") == "image_start", F.col("t")))
    times[IMAGE_STAGE] = F.when(image.between(*IMAGE_RANGE), image)
    per = rows.groupBy("run_id").agg(*[c.cast("long").alias(s) for s, c in times.items()])
    return per.select("run_id", _stage_map({s: F.col(s) for s in times}).alias("stages"))


def _stage_map(times: dict[str, Column]) -> Column:
    """Map of the stages that have a time, by name."""
    entries = F.array(*[F.struct(F.lit(s).alias("key"), times[s].alias("value")) for s in sorted(times)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("run_id")]


def merge_pool(pool: DataFrame | None, runs: DataFrame, logs: DataFrame, params: Sequence[str], n: int = 15) -> DataFrame:
    """The newest `n` usable runs per kind and values of `params`, with their stage times: those kept so far, and new ones.

    A newest-n table of a union is that of the tables' newest n, so the pool can be kept batch by batch, and a run that
    comes late finds its place. Only the logs of runs that enter are read. A run is given once; if it is in the pool
    already, the pool's row stays.
    """
    cols = ["run_id", "kind", *params, "created_at", "duration_ms", "total_tokens"]
    fresh = runs.where((F.col("status") == "done") & F.col("duration_ms").between(*DURATION_RANGE)).select(*cols)
    known = None if pool is None else pool.select("run_id")
    fresh = fresh if known is None else fresh.join(known, "run_id", "left_anti")
    fresh = written(top_k(fresh, ["kind", *params], _newest(), n, "__rank").drop("__rank"), "newest")
    fresh = fresh.join(run_stages(fresh, logs), "run_id", "left")
    both = fresh if pool is None else pool.unionByName(fresh)
    return top_k(both, ["kind", *params], _newest(), n, "__rank").drop("__rank")


def forecast_of_pool(pool: DataFrame, kind: str, params: dict[str, object] | None = None, n: int = 15, min_n: int = 3) -> DataFrame:
    """Median and p75 of the newest similar runs and their stages; too few exact matches widen the pool to the kind.

    One pass over the pool and one row, whatever is in it: the driver takes no decision between jobs.
    """
    exact = F.lit(True)
    for name, value in (params or {}).items():
        if value is not None:
            exact = exact & F.coalesce(F.col(name) == value, F.lit(False))
    rows = top_k(pool.where(F.col("kind") == kind).withColumn("exact", exact), ["exact"], _newest(), n, "__rank")
    rows = rows.withColumn("wide", F.row_number().over(Window.partitionBy("kind").orderBy(*_newest())) <= n)

    def summary(use: Column) -> list[Column]:
        mine = lambda c: F.when(use, c)
        times = {s: _half_even(F.percentile(mine(F.try_element_at("stages", F.lit(s))), 0.75)) for s in STAGES}
        return [
            F.count_if(use).alias("sample_count"), _half_even(F.percentile(mine(F.col("duration_ms")), 0.5)).alias("median_ms"),
            _half_even(F.percentile(mine(F.col("duration_ms")), 0.75)).alias("p75_ms"), _half_even(F.percentile(mine(F.col("total_tokens")), 0.5)).alias("median_tokens"),
            _stage_map(times).alias("stages"),
        ]

    one = rows.agg(F.struct(*summary(F.col("exact"))).alias("e"), F.struct(*summary(F.col("wide"))).alias("w"))
    enough = F.col("e.sample_count") >= min_n
    scope = F.when(enough, "exact").when(F.col("e.sample_count") > 0, "mixed").otherwise("kind")
    return one.select(F.when(enough, F.col("e")).otherwise(F.col("w")).alias("f"), scope.alias("scope")).select("f.*", "scope")


def duration_forecast(runs: DataFrame, logs: DataFrame, kind: str, params: dict[str, object] | None = None,
                      n: int = 15, min_n: int = 3) -> DataFrame:
    """`forecast_of_pool` over all runs: the runs and the logs are read once each."""
    used = [name for name, value in (params or {}).items() if value is not None]
    wanted = F.lit(True)
    for name in used:
        wanted = wanted & F.coalesce(F.col(name) == params[name], F.lit(False))
    # Two groups are enough for one forecast: runs that match, and the others.
    mine = runs.where(F.col("kind") == kind).withColumn("matches", wanted)
    return forecast_of_pool(merge_pool(None, mine, logs, ["matches"], n), kind, {"matches": True}, n, min_n)


def pace_rows(pulses: DataFrame) -> DataFrame:
    """Think and write time and characters per run, from merged pulses with their phase start `since`.

    Everything needed from the order of the pulses is a first or a last value, so plain aggregates suffice.
    """
    think, write = F.col("phase") == "think", F.col("phase") == "write"
    last_think = F.max_by(F.struct("t", "since"), F.when(think, F.col("t")))
    first_write = F.min_by("since", F.when(write, F.col("t")))
    last_write = F.max(F.when(write, F.col("t")))
    rows = pulses.groupBy("run_id").agg(
        F.coalesce(F.max(F.when(think, F.col("chars"))), F.lit(0)).alias("think_chars"), last_think.alias("lt"),
        F.coalesce(F.max(F.when(write, F.col("chars"))), F.lit(0)).alias("write_chars"), first_write.alias("fw"), last_write.alias("lw"),
        F.max(think).alias("thought"))
    zero = F.lit(0).cast("long")
    think_ms = F.when(F.col("thought"), F.greatest(zero, F.col("lt.t") - F.col("lt.since"))).otherwise(zero)
    write_ms = F.greatest(zero, F.coalesce(F.col("lw") - F.col("fw"), zero))
    return rows.select("run_id", "think_chars", think_ms.alias("think_ms"), "write_chars",
                       F.when(write_ms >= 1_500, write_ms).otherwise(zero).alias("write_ms"))


def pace_summary(pace: DataFrame, group: Sequence[str] = ("kind",)) -> DataFrame:
    """Median and p75 of think and write time and characters over runs above the thresholds, rounded half up."""
    least = {"think_ms": 5_000, "think_chars": 200, "write_ms": 2_000, "write_chars": 200}
    out = []
    for col, low in least.items():
        used = F.when(F.col(col) >= low, F.col(col))
        for suffix, q in (("median", 0.5), ("p75", 0.75)):
            out.append(F.round(F.percentile(used, q)).cast("long").alias(f"{col}_{suffix}"))
    return pace.groupBy(*group).agg(F.count(F.lit(1)).alias("runs"), *out)


def silent_gaps(beats: DataFrame, key: str, ts: str, order: Sequence[str], threshold_s: int = 180, slice_hours: int = 24) -> DataFrame:
    """Heartbeats followed by more than `threshold_s` of silence, with the time of the next beat (null at the end)."""
    from pressgrain.scale import neighbour

    bucket = F.floor(F.unix_timestamp(F.col(ts)) / (slice_hours * 3600))
    rows = neighbour(beats, [key], order, bucket, [ts], "__next")
    nxt = F.col(f"__next.{ts}")
    gap = F.unix_micros(nxt) - F.unix_micros(F.col(ts))
    return rows.select(*beats.columns, nxt.alias("next_at"), gap.alias("gap_us")).where(nxt.isNull() | (gap > threshold_s * 1_000_000))


def retry_due(silent: Column, stage: Column, retries: Column, allowed: Sequence[str] = ("modell",), max_retries: int = 2) -> Column:
    return silent & stage.isin(*allowed) & (retries < max_retries)


def progress_pct(elapsed: Column, rest: Column, low: int = 4, high: int = 99) -> Column:
    """Share of the expected time that has passed, between 4 and 99 percent."""
    total = elapsed + rest
    raw = F.when(total > 0, F.round(elapsed * 100 / total)).otherwise(low)
    return F.greatest(F.lit(low), F.least(F.lit(high), raw)).cast("int")


# Built-in stage times, pace and stretch used where no run has been measured yet (milliseconds, characters).
FALLBACK_STAGES = {
    "memo": {"lesen": 2_000, "recherchieren": 8_000, "modell": 170_000, "pruefen": 2_500, "bilder": 45_000, "fuellen": 2_500},
    "other": {"lesen": 2_000, "recherchieren": 0, "modell": 70_000, "pruefen": 2_500, "bilder": 0, "fuellen": 2_500},
}
FALLBACK_PACE = {
    "memo": {"think": (180_000, 280_000, 40_000, 72_000), "write": (22_000, 35_000, 5_400, 6_200)},
    "other": {"think": (55_000, 80_000, 12_000, 20_000), "write": (18_000, 28_000, 2_800, 4_000)},
}
STRETCH_MS, IMAGE_OVERTIME_MS = 180_000, 40_000


def eta_remaining(state: DataFrame, medians: DataFrame) -> DataFrame:
    """Remaining milliseconds per running run.

    `state` has run_id, kind, images, stage, elapsed, stage_start, pulse (struct of phase, t, since, chars,
    thinking_chars; null without one) and forecast_ms; `medians` has kind and a map of stage times. The current model
    stage follows its live writing or thinking rate, other stages their median; later stages add theirs.
    """
    rows = state.join(broadcast_if_small(medians), "kind", "left")
    memo = F.col("kind") == "memo"
    pictures = memo & (F.col("images") != "upload")
    applies = {s: memo if s == "recherchieren" else pictures if s == IMAGE_STAGE else F.lit(True) for s in STAGES}

    def fallback(stage: str) -> Column:
        return F.when(memo, FALLBACK_STAGES["memo"][stage]).otherwise(FALLBACK_STAGES["other"][stage]).cast("double")

    def pace(phase: str, i: int) -> Column:
        return F.when(memo, FALLBACK_PACE["memo"][phase][i]).otherwise(FALLBACK_PACE["other"][phase][i]).cast("double")

    typ = {s: F.coalesce(F.try_element_at("stages", F.lit(s)).cast("double"), fallback(s)) for s in STAGES}
    current = F.when(~F.col("stage").isin(*STAGES), "lesen").otherwise(F.col("stage"))
    for s in ("recherchieren", IMAGE_STAGE):
        current = F.when((current == s) & ~applies[s], "lesen").otherwise(current)
    rows = rows.withColumn("stage", current)
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    zero = F.lit(0.0)

    def rest_of(floor: float) -> Column:
        parts = [F.when(applies[s] & (F.lit(i + 1) > rank), F.greatest(F.lit(floor), typ[s])).otherwise(zero) for i, s in enumerate(STAGES)]
        return sum(parts[1:], parts[0])

    elapsed, spent = F.col("elapsed"), F.greatest(zero, F.col("elapsed") - F.col("stage_start"))
    pulse = F.col("pulse")
    in_stage = pulse.isNotNull() & (pulse["t"] >= F.col("stage_start"))
    since = F.coalesce(pulse["since"], F.col("stage_start"))
    phase_ms = F.greatest(F.lit(1.0), pulse["t"] - since)
    waited = F.greatest(zero, elapsed - pulse["t"])

    def goal(have: Column, phase: str) -> Column:
        return F.when(have < pace(phase, 2), pace(phase, 2)).otherwise(F.greatest(pace(phase, 2), pace(phase, 3)))

    chars, thought = pulse["chars"], pulse["thinking_chars"]
    rate = F.when(phase_ms >= 800, chars / phase_ms).otherwise(pace("write", 2) / pace("write", 0))
    writing = F.greatest(zero, F.greatest(zero, goal(chars, "write") - chars) / rate - waited)
    left = F.greatest(zero, goal(thought, "think") - thought)
    by_rate = F.when(left > 0, left / (thought / phase_ms)).otherwise(F.greatest(zero, pace("think", 1) - phase_ms))
    by_time = F.greatest(zero, F.when(phase_ms < pace("think", 0), pace("think", 0)).otherwise(pace("think", 1)) - phase_ms)
    thinking = F.greatest(zero, F.when((thought >= 80) & (phase_ms >= 800), by_rate).otherwise(by_time) - waited) + pace("write", 0)
    usual = F.greatest(zero, F.greatest(F.lit(1_000.0), typ[MODEL_STAGE]) - spent)
    model = F.when(in_stage & (pulse["phase"] == "writing") & (chars > 0), writing).when(
        in_stage & (pulse["phase"] == "thinking"), thinking).otherwise(usual)
    floor = F.greatest(F.lit(1_000.0), typ[IMAGE_STAGE], fallback(IMAGE_STAGE))
    overtime = F.greatest(F.lit(float(IMAGE_OVERTIME_MS)), F.round(IMAGE_OVERTIME_MS + (spent - floor) * 0.25))
    image = F.when(spent > floor, overtime).otherwise(floor - spent)
    here = F.try_element_at(F.create_map(*[x for s in STAGES for x in (F.lit(s), typ[s])]), F.col("stage"))
    rest = (
        F.when(F.col("stage") == MODEL_STAGE, model + rest_of(0.0)).when(F.col("stage") == IMAGE_STAGE, image + rest_of(1_000.0))
        .otherwise(F.greatest(zero, F.greatest(F.lit(1_000.0), here) - spent) + rest_of(1_000.0))
    )
    total = sum((F.when(applies[s], F.greatest(zero, typ[s])).otherwise(zero) for s in STAGES), zero)
    aim = F.when(F.col("forecast_ms") > 8_000, F.col("forecast_ms")).otherwise(total)
    rest = F.when(pulse.isNull() & (aim > elapsed), F.greatest(rest, aim - elapsed)).otherwise(rest)
    slow = (pulse["phase"] == "thinking") & ((thought >= pace("think", 3)) | (spent >= pace("think", 1)))
    late = F.coalesce(slow, F.lit(False)) | (pulse.isNull() & (elapsed > pace("think", 1)))
    stretched = F.greatest(rest, F.lit(float(STRETCH_MS)), F.round(STRETCH_MS + F.greatest(zero, spent - pace("think", 1)) * 0.4))
    rest = F.when(memo & (F.col("stage") == MODEL_STAGE) & late, stretched).otherwise(rest)
    return rows.select("run_id", "kind", "stage", "elapsed", F.greatest(F.lit(0), F.round(rest).cast("long")).alias("rest_ms"))
