"""Configurations of any depth as rows of paths: flatten, overlay, compare, put together again.

A row is (key, path, value): the dotted path of a leaf and its value as JSON text. Objects are taken apart level by level
inside their row; arrays and empty objects below the top are leaves. Keys that contain a dot cannot be told from
nested ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.operators.dedup import written


def flatten(df: DataFrame, key: str, json: Column) -> DataFrame:
    """Leaves of the configuration in `json`, one row each. Null or broken JSON, and anything but an object, gives none.

    All levels are taken apart inside the row, in one pass over the input whatever their number.
    """
    members = lambda value: F.try_variant_get(value, "$", "map<string,variant>")  # noqa: E731  null for all but objects
    inner = lambda e: F.size(e["members"]) > 0  # noqa: E731  null for all but objects

    def entries(path: Column, parts: Column) -> Column:
        return F.transform(F.map_entries(parts), lambda e: F.struct(F.concat_ws(".", path, e["key"]).alias("path"), e["value"].alias("value"), members(e["value"]).alias("members")))

    def deeper(state: Column) -> Column:
        below = F.flatten(F.transform(F.filter(state["open"], inner), lambda e: entries(e["path"], e["members"])))
        ended = F.filter(state["open"], lambda e: ~F.coalesce(inner(e), F.lit(False)))
        text = F.transform(ended, lambda e: F.struct(e["path"].alias("path"), F.to_json(e["value"]).alias("value")))
        return F.struct(below.alias("open"), F.concat(state["leaves"], text).alias("leaves"))

    # No more levels than opening braces; a step without anything open costs next to nothing.
    start = F.struct(entries(F.lit(None).cast("string"), members(F.try_parse_json(json))).alias("open"), F.array().cast("array<struct<path:string,value:string>>").alias("leaves"))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(json) - F.length(F.translate(json, "{", ""))))
    done = F.aggregate(levels, start, lambda state, _: F.when(F.size(state["open"]) > 0, deeper(state)).otherwise(state), lambda state: state["leaves"])
    return written(df.select(F.col(key).alias("key"), F.inline(done)), "config")


def _beginnings(leaves: DataFrame) -> DataFrame:
    """(key, path, at) of each leaf and each beginning `at` of its dotted path, itself included."""
    many = F.length("path") - F.length(F.translate("path", ".", "")) + 1
    numbered = leaves.select("key", "path", F.explode(F.sequence(F.lit(1), many)).alias("n"))
    return numbered.select("key", "path", F.call_function("substring_index", "path", F.lit("."), F.col("n")).alias("at"))


def _outside(path: str, places: list[str]) -> Column:
    """Whether a path lies neither at one of the places nor above or below one."""
    above = {".".join(parts[:n]) for parts in (p.split(".") for p in places) for n in range(1, len(parts) + 1)}
    below = [F.startswith(path, F.lit(f"{p}.")) for p in places]
    return ~reduce(or_, below, F.col(path).isin(*above))


def overlay(defaults: DataFrame, override: DataFrame, forced: Mapping[str, str] | None = None) -> DataFrame:
    """Defaults with the leaves of the override in their place; a leaf of the override replaces a whole section and the
    other way round. `forced` maps paths to JSON values that no override changes."""
    if forced:
        pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in forced.items()))
        guard = defaults.select("key").unionByName(override.select("key")).distinct().select("key", F.inline(pairs))
        # Forced paths are the same for all keys, so each leaf is held against them where it stands. Null keys match nothing.
        free = F.col("key").isNull() | _outside("path", list(forced))
        return overlay(defaults.where(free), override).where(free).unionByName(guard)
    taken = _beginnings(override).groupBy("key", "at").agg(F.max(F.col("at") == F.col("path")).alias("leaf"))
    gone = _beginnings(defaults).join(taken, ["key", "at"])
    gone = gone.where(F.col("leaf") | (F.col("at") == F.col("path"))).select("key", "path").distinct()
    return defaults.join(gone, ["key", "path"], "left_anti").unionByName(override)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, path, before, after) of every leaf whose value differs or that stands on one side only (null on the other)."""
    a, b = before.withColumnRenamed("value", "before"), after.withColumnRenamed("value", "after")
    return a.join(b, ["key", "path"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def nested(leaves: DataFrame) -> DataFrame:
    """(key, json): leaves put together as objects, names in ascending order."""
    depth = F.size(F.split("path", "[.]"))
    rows = leaves.select("key", "path", "value", depth.alias("depth"))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for level in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == level)
        parts = F.split("path", "[.]")
        named = here.select("key", F.array_join(F.slice(parts, 1, level - 1), ".").alias("path"), F.element_at(parts, -1).alias("name"), "value")
        quoted = F.regexp_extract(F.to_json(F.struct("name")), r'(?s)^\{"name":(.*)\}$', 1)
        entry = F.struct("name", F.concat(quoted, F.lit(":"), "value").alias("text"))
        whole = named.groupBy("key", "path").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        text = F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: e["text"]), ","), F.lit("}"))
        whole = whole.select("key", "path", text.alias("value"), F.lit(level - 1).alias("depth"))
        rows = rows.where(F.col("depth") < level).unionByName(whole)
    return rows.select("key", F.col("value").alias("json"))
