"""Registry of named queries: each has a Spark callable and, where SQL can say it, an oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressgrain.scale import spread

# Tables whose rows are long texts, with their id: per-row work dominates there.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, read lazily by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # Read timestamps without a zone as UTC instants; the file holds the same microseconds either way.
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
