"""Joins: lookups, presence and absence, intervals, nested data and scalar totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgrain.scale import broadcast_if_small


def jobs_with_text(jobs: DataFrame, articles: DataFrame, on: str, text: str, min_chars: int) -> DataFrame:
    """Jobs whose article has enough text; the length filter runs before the join."""
    return jobs.join(articles.where(F.length(text) >= min_chars), on)


def join_json_items(items: DataFrame, json_col: str, jobs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Elements of a JSON array with their position, joined to jobs on two keys."""
    rows = items.withColumn("__a", F.from_json(json_col, "array<struct<job:bigint,status:string>>"))
    rows = rows.select(*[c for c in items.columns if c != json_col], F.posexplode("__a").alias("ordinality", "item"))
    return rows.select(*[c for c in items.columns if c != json_col], "ordinality", "item.*").join(jobs, list(on))


def left_lookup(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    return facts.join(broadcast_if_small(dim), on, "left")


def missing_by_key(left: DataFrame, right: DataFrame, left_col: str, right_col: str, key: Callable[[Column], Column]) -> DataFrame:
    """Rows of `left` whose folded key does not occur in `right`."""
    other = right.select(key(F.col(right_col)).alias("__k")).distinct()
    return left.withColumn("__k", key(F.col(left_col))).join(other, "__k", "left_anti").drop("__k")


def anti_exists(left: DataFrame, right: DataFrame, on: Column | str) -> DataFrame:
    return left.join(right, on, "left_anti")


def semi_exists(left: DataFrame, right: DataFrame, on: Column | str) -> DataFrame:
    return left.join(right, on, "left_semi")


def rows_on_days(facts: DataFrame, days: DataFrame, day: Column) -> DataFrame:
    """Facts on any of the given days."""
    return facts.withColumn("usage_date", day).join(broadcast_if_small(days.select("usage_date").distinct()), "usage_date", "left_semi")


def _covers(runs: DataFrame, micros: int) -> DataFrame:
    """Pieces of the runs per (key, slice, level, cell): one holds from its time `__t` to the end of the cell (`__begin`), or
    from the start of the cell to `__t` (`__until`). Level 63 is the whole slice, level h a cell of 2^h microseconds.

    A run gives a piece where it starts, one where it ends, and one for each slice between, of which a partial maximum keeps
    the newest. A run within one slice is cut at the border of the smallest power of two that parts its ends, so it gives
    two pieces as well.
    """
    width = F.lit(micros)
    place = lambda c: F.unix_micros(c.cast("timestamp"))
    r = runs.withColumn("__s", place(F.col("__run.start"))).withColumn("__e", place(F.col("__end")))
    r = r.withColumn("__first", F.floor(F.col("__s") / width)).withColumn("__last", F.floor(F.col("__e") / width))
    ends = F.pmod("__s", width).bitwiseXOR(F.pmod("__e", width))
    high = F.when(F.col("__first") < F.col("__last"), 63).when(ends == 0, 0).otherwise(F.length(F.bin(ends)) - 1)
    piece = lambda slot, at, begin: F.struct(slot.alias("__slot"), at.alias("__t"), F.lit(begin).alias("begin"))
    start, stop = piece(F.col("__first"), F.col("__s"), True), piece(F.col("__last"), F.col("__e"), False)
    borders = r.withColumn("__level", high).select("__key", "__level", "__run", F.inline(F.when(F.col("__s") == F.col("__e"), F.array(start)).otherwise(F.array(start, stop))))
    # Of runs over the same slices only the newest can win between them.
    inner = r.where(F.col("__last") - F.col("__first") >= 2).groupBy("__key", "__first", "__last").agg(F.max("__run").alias("__run"))
    inner = inner.select("__key", F.explode(F.sequence(F.col("__first") + 1, F.col("__last") - 1)).alias("__slot"), "__run")
    inner = inner.groupBy("__key", "__slot").agg(F.max("__run").alias("__run"))
    inner = inner.select("__key", F.lit(63).alias("__level"), "__run", "__slot", (F.col("__slot") * width).alias("__t"), F.lit(True).alias("begin"))
    pieces = borders.unionByName(inner)
    return pieces.select("__key", "__slot", "__level", _cell(micros), "__t", F.when(F.col("begin"), F.col("__run")).alias("__begin"), F.when(~F.col("begin"), F.col("__run")).alias("__until"))


def _cell(micros: int) -> Column:
    at = F.pmod("__t", F.lit(micros))
    return F.when(F.col("__level") == 63, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", at, F.col("__level"))).alias("__cell")


def asof_run(events: DataFrame, runs: DataFrame, key: str, as_of: Column, slice_minutes: int = 60) -> DataFrame:
    """Newest run with the same key whose interval holds the event's time.

    Time is cut into slices, and every run into pieces that reach to a border of their cell. So within a cell the newest
    piece that holds a time is a running maximum: over the starts up to it, and over the ends from it on. No event meets a
    run one by one; work grows with the rows (and with the number of levels, one unless runs are shorter than a slice), and
    a hot key is split over its slices. An open run ends at `as_of`.
    """
    micros = slice_minutes * 60_000_000
    r = runs.select(F.col(key).alias("__key"), F.struct(F.col("started_at").alias("start"), "run_id").alias("__run"),
                    F.coalesce("finished_at", as_of).alias("__end")).where((F.col("__end") >= F.col("__run.start")) & F.col("__key").isNotNull())
    pieces = _covers(r, micros)
    levels = pieces.groupBy("__key", "__slot").agg(F.collect_set("__level").alias("__levels"))
    e = events.select("event_id", F.col(key).alias("__key"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("__t"))
    e = e.withColumn("__slot", F.floor(F.col("__t") / F.lit(micros))).join(levels, ["__key", "__slot"]).withColumn("__level", F.explode("__levels"))
    e = e.select("__key", "__slot", "__level", _cell(micros), "__t", F.struct("event_id").alias("__event"))
    cell = Window.partitionBy("__key", "__slot", "__level", "__cell")
    before = cell.orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = cell.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.unionByName(pieces, allowMissingColumns=True)
    both = both.withColumn("__begin", F.max("__begin").over(before)).withColumn("__until", F.max("__until").over(after))
    hits = both.where(F.col("__event").isNotNull()).select("__event.event_id", F.greatest("__begin", "__until").alias("m")).where("m IS NOT NULL")
    hits = hits.groupBy("event_id").agg(F.max("m").alias("m")).select("event_id", F.col("m.run_id").alias("run_id"))
    return events.join(hits, "event_id", "left")


def explode_nested(df: DataFrame, col: str, alias: str) -> DataFrame:
    return df.withColumn(alias, F.explode(col))


def embed_dim(facts: DataFrame, dim: DataFrame, on: str, cols: Sequence[str], name: str) -> DataFrame:
    """Facts with the matching dimension row as one struct."""
    packed = dim.select(on, F.struct(*cols).alias(name))
    return facts.join(broadcast_if_small(packed), on, "left")


def cross_scalar(totals: DataFrame, detail: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row of `detail`; totals of any other number of rows are an error."""
    one = totals.agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in totals.columns])
    one = one.where(F.assert_true(F.col("__n") == 1, "the totals must be one row").isNull()).drop("__n")
    return detail.join(F.broadcast(one), F.lit(True))


def entity_groups(main: Column, mentioned: Column, incidental: Column) -> Column:
    """Struct of main and other names: the others without main or incidental ones, compared case-insensitively."""
    low = lambda arr: F.transform(arr, lambda x: F.lower(F.trim(x)))
    drop = F.concat(low(main), low(incidental))
    rest = F.filter(mentioned, lambda x: ~F.array_contains(drop, F.lower(F.trim(x))))
    keys = low(rest)
    first = F.filter(rest, lambda x, i: F.array_position(keys, F.lower(F.trim(x))) == i + 1)
    return F.struct(F.array_distinct(main).alias("main"), first.alias("others"))
