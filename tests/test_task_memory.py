"""What a task holds at once: no row is written several times into an aggregation, no worker gets thousands of whole texts."""

from pyspark.sql import functions as F

from pressgrain.operators import retrieval as rt, windows as wn


def test_series_quality_counts_without_copies_of_the_rows(spark):
    rows = [(1, 0, 1, 50.0, "a"), (1, 1, 2, 50.0, None), (2, 0, 1, 60.0, "a"), (2, 1, 1, 70.0, "b"), (3, 0, 1, 100.0, None)]
    df = spark.createDataFrame(rows, "g long, pos long, label long, value double, unit string")
    out = wn.series_quality(df, ["g"], "pos", "label", "value", "unit")
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: r["issues"] for r in out.collect()} == {1: [], 2: ["labels_repeat", "units_differ", "not_ascending", "shares_not_100", "funnel_rises"], 3: []}


def test_retrieval_takes_texts_in_small_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("n"), F.array().cast("array<string>").alias("wanted"))
    entries = spark.createDataFrame([("x", 1, "alpha beta", ["alpha"])], "offering_id string, position long, label string, words array<string>")
    past = rt._past

    def watched(shard, k, least):
        run = past(shard, k, least)

        def small(batches):
            def each():
                for b in batches:
                    assert len(b) <= 500
                    yield b
            yield from run(each())

        return small

    monkeypatch.setattr(rt, "_past", watched)
    assert rt.top_entries(texts, entries, 1, 10).count() == 3000
