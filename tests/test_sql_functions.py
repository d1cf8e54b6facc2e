"""SQL functions against the Column functions, and table functions against the DataFrame reports."""

import pytest
from pyspark.sql import functions as F

from pressgrain.functions import text as tx
from pressgrain.functions.urls import host_of
from pressgrain.operators import aggregates as ag, config as cf
from pressgrain.sqlfunctions import register_reports, register_text_functions

TEXTS = [None, "", "Größe & Straße 2024 – ﬁn ½ ™", "İstanbul Ünïcödé\n漢字 ①②", "press release: Big Brand launches 2023 campaign", "a" * 5_000 + " ß", "plain ascii Text", "O'Neil \\ \"quoted\" $1"]


def test_scalar_functions_equal_the_columns(spark):
    names = register_text_functions(spark)
    assert len(names) >= 8
    df = spark.createDataFrame([(i, t, TEXTS[-i - 1]) for i, t in enumerate(TEXTS)], "id long, a string, b string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("""SELECT id, pg_fold(a) f, pg_norm_text(a) n, pg_evidence_skeleton(a) e, pg_content_hash(a) h, pg_canonical_headline(a) c, pg_headline_tokens(a) t,
        pg_token_similarity(a, b) s, pg_contains_term(pg_norm_text(a), b) k, pg_host_of(concat('https://www.', a)) u, pg_clamp01(id - 2) z FROM sql_texts""")
    a, b = F.col("a"), F.col("b")
    want = df.select("id", tx.fold(a).alias("f"), tx.norm_text(a).alias("n"), tx.evidence_skeleton(a).alias("e"), tx.content_hash(a).alias("h"), tx.canonical_headline(a).alias("c"), tx.headline_tokens(tx.canonical_headline(a)).alias("t"),
                     tx.token_similarity(a, b)["score"].alias("s"), tx.contains_term(tx.norm_text(a), b).alias("k"), host_of(F.concat(F.lit("https://www."), a)).alias("u"), tx.clamp01((F.col("id") - 2).cast("double")).alias("z"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pg_" not in plan and "Python" not in plan


def test_table_functions_take_named_arguments_and_lateral(spark):
    from pressgrain.plans import fixtures as fx
    from pressgrain.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    costed = fx.costed(t)
    costed.createOrReplaceTempView("sql_usage")
    t.events.selectExpr("CASE WHEN event_id % 2 = 0 THEN array('sales') ELSE array('marketing', 'buying_center') END AS routing", "concat('v', event_id % 6) AS version", "ts AS classified_at").createOrReplaceTempView("sql_articles")
    register_reports(spark, "sql_usage", "sql_articles")
    same = lambda x, y: sorted(map(str, x.select(*sorted(x.columns)).collect())) == sorted(map(str, y.select(*sorted(x.columns)).collect()))
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) if c != "cost_usd" else F.col(c).cast("decimal(38,9)").alias(c) for c in df.columns])
    assert same(text(spark.sql("SELECT * FROM pg_usage_report(since => TIMESTAMP'2024-01-10')")), text(ag.usage_report(costed, "2024-01-10")))
    assert same(text(spark.sql("SELECT * FROM pg_usage_report(run_id => 3, since => TIMESTAMP'2024-01-10')")), text(ag.usage_report(costed, "2024-01-10", run_id=3)))
    assert same(text(spark.sql("SELECT * FROM pg_usage_report(TIMESTAMP'2024-01-10', unassigned => TRUE, operations => array('click', 'view'))")), text(ag.usage_report(costed, "2024-01-10", unassigned_only=True, unassigned_operations=["click", "view"])))
    ledger = ag.local_ledger(costed, "Europe/Berlin", r"^simple-v[1-9][0-9]*(\.|$)").drop("first_event_at", "last_event_at", "error_count")
    got = spark.sql(r"SELECT * FROM pg_local_ledger(pattern => '^simple-v[1-9][0-9]*(\\.|$)', tz => 'Europe/Berlin')")
    assert same(text(got), text(ledger))
    both = spark.sql("SELECT w.track, v.* FROM VALUES ('sales'), ('marketing') AS w(track), LATERAL pg_version_list(tracks => array(w.track)) v")
    want = [ag.version_list(spark.table("sql_articles"), [x]).select(F.lit(x).alias("track"), "*") for x in ("sales", "marketing")]
    assert same(both, want[0].unionByName(want[1]))


DEEP = '{"a":{"b":{"c":{"d":1,"e":"x\\"y"}},"list":[1,{"k":2}],"none":null},"top":true,"empty":{}}'


def test_configuration_of_four_levels_round_trips(spark):
    import json

    df = spark.createDataFrame([(1, DEEP), (2, "{}"), (3, None), (4, "broken"), (5, "[1]"), (6, '{"q\\"":{"r":2}}')], "id long, j string")
    leaves = cf.flatten(df, "id", F.col("j"))
    rows = {(r["key"], r["path"]): r["value"] for r in leaves.collect()}
    assert rows == {(1, "a.b.c.d"): "1", (1, "a.b.c.e"): '"x\\"y"', (1, "a.list"): '[1,{"k":2}]', (1, "a.none"): "null", (1, "top"): "true", (1, "empty"): "{}", (6, 'q".r'): "2"}
    back = {r["key"]: json.loads(r["json"]) for r in cf.nested(leaves).collect()}
    assert back == {1: json.loads(DEEP), 6: {'q"': {"r": 2}}}


def test_overlay_and_changes_at_any_depth(spark):
    one = lambda j: cf.flatten(spark.createDataFrame([(1, j)], "id long, j string"), "id", F.col("j"))
    base, over = one('{"a":{"b":{"c":1,"d":2},"e":3},"f":{"g":4},"h":5}'), one('{"a":{"b":{"c":9},"e":{"x":7}},"f":8,"n":{"m":{"k":0}}}')
    merged = cf.overlay(base, over, {"h": "5", "a.b.d": "2", "n.m.k": "1"})
    assert {r["path"]: r["value"] for r in merged.collect()} == {"a.b.c": "9", "a.b.d": "2", "a.e.x": "7", "f": "8", "h": "5", "n.m.k": "1"}
    found = {r["path"]: (r["before"], r["after"]) for r in cf.changes(base, merged).collect()}
    assert found == {"a.b.c": ("1", "9"), "a.e": ("3", None), "a.e.x": (None, "7"), "f.g": ("4", None), "f": (None, "8"), "n.m.k": (None, "1")}
    assert cf.changes(base, base).count() == 0 and cf.flatten(spark.createDataFrame([], "id long, j string"), "id", F.col("j")).count() == 0
