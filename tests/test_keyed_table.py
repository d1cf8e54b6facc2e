"""Keyed writes on stored tables: results, files left alone, failed and competing writers."""

import pytest
from pyspark.sql import functions as F

from pressgrain.operators.keyed_table import Conflict, KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(1_000).select("id", (F.col("id") * 2).alias("v"), F.lit("old").alias("s"))
    return KeyedTable(spark, f"file://{tmp_path}/t").create(rows, ["id"], 16)


def content(df):
    return {r["id"]: (r["v"], r["s"]) for r in df.collect()}


def changed_files(table, before, after):
    old, new = table.manifest(before)["folders"], table.manifest(after)["folders"]
    return {b for b in {*old, *new} if old.get(b) != new.get(b)}


def test_upsert_rewrites_only_touched_buckets(spark, table):
    want = content(table.read())
    source = spark.createDataFrame([(5, 1, "new"), (2_000, 7, None)], "id long, v long, s string")
    touched = table.upsert(source)
    assert 1 <= len(touched) <= 2 and changed_files(table, 0, 1) == set(touched)
    assert content(table.read()) == want | {5: (1, "new"), 2_000: (7, None)}
    assert content(table.read(0)) == want and table.read().count() == 1_001


def test_update_delete_insert(spark, table):
    want = content(table.read())
    source = spark.createDataFrame([(5, None, "u"), (6, 60, None), (9_999, 1, "x")], "id long, v long, s string")
    touched = table.update_from(source, ["v", "s"])
    want |= {5: (10, "u"), 6: (60, "old")}
    assert content(table.read()) == want and len(touched) <= 2 and changed_files(table, 0, 1) == set(touched)
    assert table.delete_using(source.where("id > 100")) == [] and table.version() == 1  # no such key, no new version
    touched = table.delete_using(source.where("id < 6"))
    want.pop(5)
    assert content(table.read()) == want and len(touched) == 1
    added = table.insert_ignore(spark.createDataFrame([(6, 0, "no"), (5, 55, "back")], "id long, v long, s string"))
    want[5] = (55, "back")
    assert content(table.read()) == want and len(added) == 1
    assert len(table.manifest()["folders"][added[0]]) == 2  # added next to the old file


def test_failed_writer_leaves_the_old_version(spark, table):
    want = content(table.read())
    fails = spark.range(10).select("id", F.col("id").alias("v"), F.raise_error(F.lit("lost")).cast("string").alias("s"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(fails)
    assert table.version() == 0 and content(table.read()) == want
    table.upsert(spark.createDataFrame([(1, 0, "x")], "id long, v long, s string"))
    assert content(table.read()) == want | {1: (0, "x")}
    table.upsert(table.read())  # all buckets anew: no folder of the versions before is needed
    assert set(table.unreferenced(3)) < set(table.unreferenced(1)) and len(table.unreferenced(1)) >= 2


def test_second_writer_of_a_version_gets_an_error(spark, table, monkeypatch):
    one = spark.createDataFrame([(1, 0, "one")], "id long, v long, s string")
    stale = table._now()
    table.upsert(one)
    monkeypatch.setattr(table, "_now", lambda: stale)
    with pytest.raises(Conflict):
        table.upsert(one.withColumn("s", F.lit("two")))
    monkeypatch.undo()
    assert content(table.read())[1] == (0, "one")


def test_empty_tables_and_sources(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v long, s string")
    table = KeyedTable(spark, f"file://{tmp_path}/e")
    assert table.version() == -1
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(none, ["id"], 4)
    assert table.read().count() == 0 and table.upsert(none) == [] and table.delete_using(none) == []
    table.upsert(spark.createDataFrame([(3, 1, "a")], none.schema))
    table.delete_using(spark.createDataFrame([(3,)], "id long"))
    assert table.read().count() == 0 and table.manifest()["folders"] == {}
