"""Places of rows in their groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgrain.llm.common import saved


def ranked(df: DataFrame, group: str, order: Sequence[str | Column], out: str = "place", total: str = "n") -> DataFrame:
    """`df` with `out`, the place (from 0) of each row in its `group` by `order`, and `total`, the rows of the group.

    Rows are dealt out by ranges of group and order, so a hot group spreads over many tasks; only one row per group and
    task is summed up. The result is a table in the shared folder: places do not change when an executor is lost. `group`
    must not be null; nulls in `order` come first. Equal rows get places in any order. `df` should be a written table,
    since ranges are drawn from a sample of it.
    """
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = saved(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranked")
    spans = rows.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    every = Window.partitionBy(group)
    before = F.sum("__rows").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(group, "__part", (F.col("__first") - F.coalesce(before, F.lit(0))).alias("__base"), F.sum("__rows").over(every).alias(total))
    joined = rows.join(spans, [group, "__part"])
    return joined.withColumn(out, F.col("__at") - F.col("__base")).drop("__part", "__at", "__base")
