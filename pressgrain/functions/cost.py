"""Tariffs, usage cost, currency and score arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.scale import broadcast_if_small

# Peak hours (UTC) and the price list in USD per million tokens (input, cached input, output).
PEAK_HOURS = [(1, 4), (6, 10)]
RATES = [
    ("deepseek-v4-pro", False, "0.66", "0.022", "1.98"),
    ("deepseek-v4-pro", True, "1.32", "0.044", "3.96"),
    ("deepseek-v4-flash", False, "0.22", "0.007", "0.66"),
    ("deepseek-v4-flash", True, "0.44", "0.014", "1.32"),
    ("gemini-2.5-flash-lite", False, "0.1", "0.1", "0.4"),
    ("gemini-2.5-flash-lite", True, "0.1", "0.1", "0.4"),
    ("gemini-2.5-flash", False, "0.3", "0.3", "2.5"),
    ("gemini-2.5-flash", True, "0.3", "0.3", "2.5"),
]
DEFAULT_MODEL = "deepseek-v4-pro"
MONEY = "decimal(18,9)"


def peak_flag(ts: Column, windows: Sequence[tuple[int, int]] = PEAK_HOURS) -> Column:
    """True inside a peak window; the end hour itself is off-peak again."""
    hour = F.hour(ts)
    out = F.lit(False)
    for start, end in windows:
        out = out | ((hour >= start) & (hour < end))
    return out


def rate_table(spark, rows=RATES) -> DataFrame:
    raw = spark.createDataFrame(rows, "model string, peak boolean, r_in string, r_cached string, r_out string")
    return raw.select("model", "peak", *[F.col(c).cast("decimal(10,4)").alias(c) for c in ("r_in", "r_cached", "r_out")])


def rate_lookup(events: DataFrame, catalogue: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Add the rates valid at `created_at`; unknown models get those of the default model.

    The catalogue has one row per model and tariff and is broadcast if it is small; the default falls out of the same join by
    rewriting unknown model names against the small list of known ones.
    """
    known = catalogue.select(F.col("model").alias("__known")).distinct()
    rows = events.join(broadcast_if_small(known), F.col("model") == F.col("__known"), "left")
    rows = rows.withColumn("__model", F.coalesce("__known", F.lit(default))).withColumn("peak", peak_flag(F.col("created_at")))
    rates = catalogue.withColumnRenamed("model", "__model")
    return rows.join(broadcast_if_small(rates), ["__model", "peak"], "left").withColumnRenamed("__model", "rate_model").drop("__known")


def usage_cost(inp: Column, cached: Column, out: Column, thinking: Column,
               r_in: Column, r_cached: Column, r_out: Column) -> Column:
    total = inp * r_in + cached * r_cached + (out + thinking) * r_out
    return (total / F.lit(1_000_000)).cast(MONEY)


def fx_snapshot(usd: Column, currency: Column, usd_native: str, native_eur: str, usd_eur: str) -> Column:
    """Struct of native cost, rate and EUR cost frozen at write time."""
    foreign = currency != "USD"
    native = F.when(foreign, usd * F.lit(usd_native).cast("decimal(12,9)")).otherwise(usd).cast(MONEY)
    rate = F.when(foreign, F.lit(native_eur).cast("decimal(9,5)")).otherwise(F.lit(usd_eur).cast("decimal(9,5)"))
    return F.struct(native.alias("native_cost"), rate.alias("native_to_eur"), (native * rate).cast(MONEY).alias("cost_eur"))


def weighted_score(parts: Sequence[Column], weights: Sequence[float], fallback: Column) -> Column:
    """Weighted mean of parts clamped to 0..100, rounded half up; the fallback where it comes out as 0."""
    def part(c):
        x = F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))

    total = sum((part(c) * F.lit(float(w)) for c, w in zip(parts, weights)), F.lit(0.0))
    score = F.round(total / sum(weights)).cast("int")
    back = F.round(part(fallback)).cast("int")
    return F.when(score > 0, F.least(F.lit(100), score)).otherwise(back)
