"""Table maintenance without a merge statement: anti-joins, unions and partition overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.dates import visible_date


def repair_dates(articles: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Replace `published` by the date visible at the head of `content`; reset `status` of rows that turn out old."""
    shown = visible_date(F.col("content"))
    rows = articles.withColumn("__shown", F.when(shown <= as_of, shown))
    old = F.col("__shown") < F.add_months(as_of, -months)
    return (
        rows.withColumn("published", F.coalesce("__shown", "published"))
        .withColumn("status", F.when(old, "legacy").otherwise(F.col("status")))
        .drop("__shown")
    )


def remap_category(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Replace values by a fixed mapping and flag the rows that really changed."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    new = F.coalesce(F.try_element_at(table, F.col(col)), F.col(col))
    return df.withColumn("changed", ~new.eqNullSafe(F.col(col))).withColumn(col, new)


def valid_date(col: Column, fmt: str) -> Column:
    """True where a text is a calendar date in exactly this format."""
    day = F.to_date(F.try_to_timestamp(col, F.lit(fmt)))
    return F.coalesce(F.date_format(day, fmt) == col, F.lit(False))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the source's rows in place of those with the same key; the source holds one row per key."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key is new."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def update_from(target: DataFrame, source: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Target with non-null values of the source in the named columns; the source holds one row per key."""
    new = source.select(*on, *[F.col(c).alias(f"__new_{c}") for c in cols])
    rows = target.join(new, on, "left")
    for c in cols:
        rows = rows.withColumn(c, F.coalesce(f"__new_{c}", c))
    return rows.drop(*[f"__new_{c}" for c in cols]).select(*target.columns)


def delete_using(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    return target.join(source.select(*on), on, "left_anti")


def refresh_affected(derived: DataFrame, facts: DataFrame, changed: DataFrame, day: str, rebuild) -> DataFrame:
    """Derived table with the days of `changed` rebuilt from all facts of those days and the other days kept."""
    days = changed.select(day).distinct()
    return derived.join(days, day, "left_anti").unionByName(rebuild(facts.join(days, day, "left_semi")))


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in `df`; the rebalance hint lets AQE split a hot partition over several tasks."""
    df.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_snapshot(history: DataFrame, current: DataFrame, key: list[str], as_of: Column) -> DataFrame:
    """History plus one immutable JSON row per current row, unless (key, as-of) is already there."""
    snap = current.select(*key, as_of.alias("as_of"), F.to_json(F.struct("*")).alias("snapshot"))
    fresh = snap.join(history.select(*key, "as_of"), [*key, "as_of"], "left_anti")
    return history.unionByName(fresh)


USAGE_STATUSES = ["success", "error", "empty"]


def append_usage(events: DataFrame) -> DataFrame:
    """Ledger rows of provider calls: input is fresh plus cached, every token kind at least 0, errors are billed too."""
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    fresh, cached, out, think = n("fresh_input"), n("cached_input"), n("output"), n("thinking")
    total = F.coalesce(F.nullif(n("total"), F.lit(0).cast("long")), fresh + cached + out + think)
    return events.select(
        "event_id", "created_at", "operation", "model",
        F.when(F.col("status").isin(*USAGE_STATUSES), F.col("status")).otherwise("error").alias("status"),
        (fresh + cached).alias("input_tokens"), cached.alias("cached_input_tokens"), out.alias("output_tokens"),
        think.alias("thinking_tokens"), total.alias("total_tokens"))


def validate_constraints(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy every rule, and the others with the names of the rules they break. Unknown counts as satisfied."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    rows = df.withColumn("violations", broken)
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Seed or rule rows as a table; small by nature and broadcast in joins."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def add_counters(target: DataFrame, increments: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Target with the summed non-negative increments added to its counters."""
    sums = increments.groupBy(key).agg(*[F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(f"__{c}") for c in cols])
    rows = target.join(sums, key, "left")
    for c in cols:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0)))
    return rows.drop(*[f"__{c}" for c in cols]).select(*target.columns)
