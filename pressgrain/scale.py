"""Building blocks that keep hot keys from landing in one task.

A plain `partitionBy(key)` window sends every row of a key to one task. Where a key may hold a large share of the
table, the helpers here split each key into ordered buckets (a time slice, a position range), work inside
(key, bucket), and carry the few values that cross a bucket border through a table with one row per (key, bucket).
Group columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BROADCAST_LIMIT_ROWS, BROADCAST_LIMIT_BYTES = 200_000, 32 << 20


def is_small(df: DataFrame, max_rows: int = BROADCAST_LIMIT_ROWS) -> bool:
    """Whether the table has at most `max_rows` rows and few bytes, by a look at `max_rows + 1` of them. Bytes are those of
    the rows written out as text."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and size <= BROADCAST_LIMIT_BYTES


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_LIMIT_ROWS) -> DataFrame:
    """Hint a broadcast only where `is_small` holds; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a table that was read in fewer splits than there are cores; leave any larger table as it is.

    A small file comes as one split and would keep all per-row text work on one core. A table with splits for all
    cores is not shuffled. Reading the number of splits plans the scan and runs nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _attach(rows: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join on plain equality of the keys, so that the partitioning of a window over them is reused."""
    return rows.join(edges.select(*keys, value), list(keys), "left")


def neighbour(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    take: Sequence[str],
    out: str,
    forward: bool = True,
) -> DataFrame:
    """`lead`/`lag` of `struct(take)` within `group`, ordered by `order`, computed per (group, bucket).

    `bucket` must grow with the first order column. The neighbour of a bucket's last (first) row is the first (last)
    row of the nearest non-empty bucket, read from one edge row per (group, bucket).
    """
    rows = df.withColumn("__b", bucket)
    keys = [*group, "__b"]
    payload, position = F.struct(*take), F.struct(*order)
    inside = Window.partitionBy(*keys).orderBy(*order)
    shift = F.lead if forward else F.lag
    rows = rows.withColumn("__near", shift(payload).over(inside))
    edge = (F.min_by if forward else F.max_by)(payload, position)
    edges = df.withColumn("__b", bucket).groupBy(*keys).agg(edge.alias("__edge"))
    across = Window.partitionBy(*group).orderBy("__b") if group else Window.orderBy("__b")
    edges = edges.select(*keys, shift("__edge").over(across).alias("__far"))
    joined = _attach(rows, edges, keys, "__far")
    return joined.withColumn(out, F.coalesce("__near", "__far")).drop("__b", "__near", "__far")


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Running sum of `value` within `group`: a window per (group, bucket) plus the totals of earlier buckets."""
    keys = [*group, "__b"]
    rows = df.withColumn("__b", bucket)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(value).over(inside))
    across = Window.partitionBy(*group) if group else Window.partitionBy()
    before = across.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.withColumn("__b", bucket).groupBy(*keys).agg(F.sum(value).alias("__total"))
    totals = totals.select(*keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    joined = _attach(rows, totals, keys, "__before")
    return joined.withColumn(out, F.col("__run") + F.col("__before")).drop("__b", "__run", "__before")


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], width: float
) -> DataFrame:
    """Exact linear-interpolated percentiles without holding a group in one buffer.

    Counts per value slice of `width` locate the slices that hold the wanted ranks; only those slices are ranked.
    """
    data = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    data = data.withColumn("__s", F.floor(F.col("__v") / F.lit(width)))
    keys = [*group, "__s"]
    slices = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *keys,
        "__n",
        F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__all"),
    )
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    wanted = slices.withColumn("__p", F.explode(ranks)).withColumn("__r", F.col("__p") * (F.col("__all") - 1))
    wanted = wanted.withColumn("__x", F.explode(F.array_distinct(F.array(F.floor("__r"), F.ceil("__r")))))
    wanted = wanted.where((F.col("__x") >= F.col("__before")) & (F.col("__x") < F.col("__before") + F.col("__n")))
    needed = wanted.select(*keys).distinct()
    values = data.join(needed, [*keys], "left_semi").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    inside = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("__lo", F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    hits = wanted.join(values, keys).where(
        (F.col("__x") - F.col("__before") >= F.col("__lo"))
        & (F.col("__x") - F.col("__before") < F.col("__lo") + F.col("__c"))
    )
    at = hits.groupBy(*group, "__p", "__r").agg(F.min("__v").alias("__a"), F.max("__v").alias("__z"))
    point = F.col("__a") + (F.col("__z") - F.col("__a")) * (F.col("__r") - F.floor("__r"))
    return at.select(*group, F.col("__p").alias("prob"), point.alias("value"), (F.floor("__r")).alias("rank"))
