"""Usage, cost and status aggregates; every one combines partial results before its shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.scale import exact_percentiles

TOKENS = ["input_tokens", "cached_input_tokens", "output_tokens", "thinking_tokens", "total_tokens"]


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def usage_by_article(events: DataFrame) -> DataFrame:
    """Requests, token and cost sums and the last time per article with any tokens."""
    rows = events.where(F.col("article_id").isNotNull() & (F.coalesce("total_tokens", F.lit(0)) > 0))
    return rows.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("requests"), *[_sum(c) for c in TOKENS], _sum("cost_usd"), F.max("created_at").alias("updated_at"))


LEDGER_KEYS = ["usage_date", "model", "operation", "status"]


def local_day(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz)) if tz != "UTC" else F.to_date(ts)


def ledger_keys(events: DataFrame, tz: str = "UTC") -> DataFrame:
    named = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in LEDGER_KEYS[1:]]
    rest = [c for c in events.columns if c not in LEDGER_KEYS]
    return events.select(local_day(F.col("created_at"), tz).alias("usage_date"), *named, *rest)


def ledger_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status") == "error").alias("error_count"),
        *[_sum(c) for c in TOKENS], _sum("cost_usd"),
        F.min("created_at").alias("first_event_at"), F.max("created_at").alias("last_event_at"),
    ]


def daily_ledger(events: DataFrame, tz: str = "UTC") -> DataFrame:
    """One row per day, model, operation and status with counts, sums and first and last time."""
    return ledger_keys(events, tz).groupBy(*LEDGER_KEYS).agg(*ledger_measures())


def local_ledger(events: DataFrame, tz: str, version_pattern: str) -> DataFrame:
    """The ledger by local day over events whose prompt version matches."""
    return daily_ledger(events.where(F.col("prompt_version").rlike(version_pattern)), tz)


def usage_report(events: DataFrame, since, run_id=None, unassigned_only: bool = False,
                 unassigned_operations: Sequence[str] = ()) -> DataFrame:
    """Usage per model, operation and status since a time; parameters pick the predicate before planning."""
    rows = events.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if run_id is not None:
        rows = rows.where(F.col("crawl_run_id") == run_id)
    elif unassigned_only:
        rows = rows.where(F.col("crawl_run_id").isNull() & F.col("operation").isin(*unassigned_operations))
    keys = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("model", "operation", "status")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("request_count"), F.countDistinct("article_id").alias("article_count"),
                                   *[_sum(c) for c in TOKENS], _sum("cost_usd"))


def percentiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], width: float) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group and probability."""
    return exact_percentiles(df, group, value, probs, width)


def stage_totals(segments: DataFrame, keys: Sequence[str], sum_stage: str) -> DataFrame:
    """Per run and stage: the sum for one stage, the longest for all others."""
    total = F.when(F.col("stage") == sum_stage, F.sum("dur")).otherwise(F.max("dur"))
    return segments.groupBy(*keys, "stage").agg(total.alias("dur"))


def to_object(df: DataFrame, group: Sequence[str], key: str, value: str) -> DataFrame:
    """Key-value pairs of a group as one map with sorted keys; for groups of enumerated keys such as stages."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.groupBy(*group).agg(F.map_from_entries(pairs).alias("object"))


def groups_with_min(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def version_list(articles: DataFrame, tracks: Sequence[str]) -> DataFrame:
    """Versions with article count, first and last time, for articles routed to any of the tracks; newest first."""
    wanted = F.array(*[F.lit(x) for x in tracks])
    rows = articles.where(F.arrays_overlap("routing", wanted) & F.col("version").isNotNull())
    out = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n_articles"), F.min("classified_at").alias("first_at"),
                                      F.max("classified_at").alias("last_at"))
    return out.orderBy(F.desc_nulls_last("last_at"), F.desc("version"))


def status_counts(df: DataFrame, buckets: Mapping[str, Column]) -> DataFrame:
    """One row of counters: how many rows satisfy each named condition."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in buckets.items()])


def error_breakdown(errors: DataFrame, item: str, code: str, order: str) -> DataFrame:
    """Items counted under the first error code they met, with the total of their errors."""
    first = errors.groupBy(item).agg(F.min_by(code, F.struct(F.col(order), F.col("event_id"))).alias("code"), F.count(F.lit(1)).alias("n"))
    return first.groupBy("code").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_errors"))


def facet_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-blank values of several columns as (facet, value, n), from one pass over the data."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols]))
    rows = df.select(pairs.alias("p")).select("p.*").where("value is not null and trim(value) <> ''")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def empty_sources(sources: DataFrame, items: DataFrame, on: str, listed: DataFrame) -> DataFrame:
    """Active, crawled sources without any stored item that are not on a list."""
    rows = sources.where("active and crawled").join(items.select(on).distinct(), on, "left_anti")
    return rows.join(listed.select(on).distinct(), on, "left_anti")


def cost_breakdown(events: DataFrame, usd_eur: str) -> DataFrame:
    """Model rows with their operations nested, both with EUR cost (stored, else converted) and shares."""
    eur = F.coalesce(F.col("cost_eur"), F.col("cost_usd") * F.lit(usd_eur).cast("decimal(9,5)"))
    ops = events.groupBy("model", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum(eur).alias("eur"), F.sum("total_tokens").alias("tokens"))
    nested = F.sort_array(F.collect_list(F.struct("operation", "n", "eur", "tokens")))
    return ops.groupBy("model").agg(F.sum("n").alias("n"), F.sum("eur").alias("eur"), F.sum("tokens").alias("tokens"), nested.alias("operations"))


def attempt_rollup(attempts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Crawl counters per group and the rejection breakdown maps summed key by key."""
    counts = attempts.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("discovered", "candidates", "rejected", "inserted")])
    parts = attempts.select(*group, F.explode("breakdown").alias("reason", "n")).groupBy(*group, "reason").agg(F.sum("n").alias("n"))
    return counts.join(to_object(parts, group, "reason", "n").withColumnRenamed("object", "breakdown"), list(group), "left")


def run_progress(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Total and processed (done, missing or error) items and the share in percent."""
    done = F.count_if(F.col("state").isin("done", "missing", "error"))
    out = items.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), done.alias("processed"))
    return out.withColumn("percent", F.round(F.col("processed") * 100 / F.col("total")).cast("int"))
