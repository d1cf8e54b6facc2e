"""Configurations of any depth: overlay against brute force, and how often its plan reads its inputs."""

import json
import random

from pyspark.sql import functions as F

from pressgrain.operators import config as cf


def leaves(value, path=""):
    if not isinstance(value, dict) or (not value and path):
        return {path: json.dumps(value, separators=(",", ":"))}
    return {p: v for k, x in value.items() for p, v in leaves(x, f"{path}.{k}" if path else k).items()}


def drawn(draw, depth=0):
    if depth == 5 or (depth and draw.random() < 0.4):
        return draw.choice([1, "a{b", None, [], [{"a": {}}], {}, True])
    return {draw.choice("abc"): drawn(draw, depth + 1) for _ in range(draw.randint(1, 3))}


def conflict(p, q):
    return p == q or p.startswith(f"{q}.") or q.startswith(f"{p}.")


def over(below, above):
    return {p: v for p, v in below.items() if not any(conflict(p, q) for q in above)} | above


def rows(df):
    found = df.collect()
    assert len(found) == len({(r["key"], r["path"]) for r in found})
    return {(r["key"], r["path"]): r["value"] for r in found}


def test_overlay_equals_brute_force(spark):
    draw = random.Random(4)
    pairs = [(k, drawn(draw), drawn(draw)) for k in range(80)]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in pairs], "id long, a string, b string")
    base, override = cf.flatten(df, "id", F.col("a")), cf.flatten(df, "id", F.col("b"))
    assert rows(base) == {(k, p): v for k, a, _ in pairs for p, v in leaves(a).items()}
    assert rows(cf.overlay(base, override)) == {(k, p): v for k, a, b in pairs for p, v in over(leaves(a), leaves(b)).items()}
    forced = {"a.b": "7", "c": "null"}
    assert rows(cf.overlay(base, override, forced)) == {(k, p): v for k, a, b in pairs for p, v in over(over(leaves(a), leaves(b)), forced).items()}


def test_null_keys_match_nothing(spark):
    df = spark.createDataFrame([(None, "a.b", "1"), (1, "a.b", "1")], "key long, path string, value string")
    found = cf.overlay(df, df.withColumn("value", F.lit("2")), {"a": "3"}).collect()
    assert sorted((r["key"] or 0, r["path"], r["value"]) for r in found) == [(0, "a", "3"), (0, "a.b", "1"), (0, "a.b", "2"), (1, "a", "3")]


def test_each_input_is_read_a_few_times_only(spark):
    df = spark.range(3).select(F.col("id"), F.lit('{"a":{"b":{"c":{"d":1}}}}').alias("a"), F.lit('{"a":{"b":{"x":2}}}').alias("b"))
    base, override = cf.flatten(df, "id", F.col("a")), cf.flatten(df, "id", F.col("b"))
    found = cf.changes(base, cf.overlay(base, override, {"a.y.z": "1"}))
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") <= 8
