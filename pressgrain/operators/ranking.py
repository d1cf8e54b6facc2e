"""Newest rows, top rows, pages and view orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per group with their rank.

    The rank filter lets Spark keep at most `k` rows per group on every map task before the shuffle, so the task that
    finishes a hot group receives k rows per upstream task, not the group.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def newest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "__rank").drop("__rank")
