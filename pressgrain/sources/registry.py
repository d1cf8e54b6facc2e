"""Source registry: derived types and crawl policies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source types by category, and the crawl defaults of a type.
TYPE_BY_CATEGORY = {"Events & Messen": "event", "Unternehmen": "corporate_newsroom", "Social": "social"}
DEFAULT_POLICY = {"max_depth": "2", "max_pages": "40", "require_topic": "true"}
TYPE_POLICY = {
    "event": {"max_depth": "1", "max_pages": "24", "require_tier1": "true"},
    "corporate_newsroom": {"require_tier1": "false"},
}


def _literal(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")


def source_policy(sources: DataFrame, types: Mapping[str, str] = TYPE_BY_CATEGORY, default: Mapping[str, str] = DEFAULT_POLICY,
                  by_type: Mapping[str, Mapping[str, str]] = TYPE_POLICY) -> DataFrame:
    """Sources with `source_type` (given, else by category, else editorial) and the merged `policy` map.

    Later layers win: defaults, defaults of the type, then the source's own JSON configuration.
    """
    derived = F.coalesce(F.nullif(F.trim("source_type"), F.lit("")), F.try_element_at(_literal(types), F.col("category")), F.lit("editorial"))
    rows = sources.withColumn("source_type", derived)
    layer = F.lit(None).cast("map<string,string>")
    for name, pairs in by_type.items():
        layer = F.when(F.col("source_type") == name, _literal(pairs)).otherwise(layer)
    over = lambda a, b: F.map_zip_with(a, F.coalesce(b, _literal({})), lambda k, x, y: F.coalesce(y, x))
    own = F.from_json("crawl_config", "map<string,string>")
    return rows.withColumn("policy", over(over(_literal(default), layer), own))
