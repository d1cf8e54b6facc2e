"""Streams over several small files, one per trigger, against the batch form of the same operator."""

import pytest
from pyspark.sql import functions as F

from pressgrain.operators import aggregates as ag, runs as rn, windows as wn
from pressgrain.streaming import streams as st


def split_events(spark, folder, n=4):
    """Events in time order over n files."""
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    slice_of = F.floor((F.dayofmonth("ts") - 1) / (30 / n))
    for i in range(n):
        ev.where(slice_of == i).coalesce(1).write.parquet(f"{folder}/events_{i}.parquet")
    return ev


def stream_of(spark, folder):
    schema = spark.read.parquet(f"{folder}/events_0.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def usage(df):
    zero = F.lit(0).cast("long")
    return df.select("event_id", F.col("ts").alias("created_at"), F.lit("m").alias("model"), F.col("event_type").alias("operation"),
                     F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("event_id").alias("input_tokens"), zero.alias("cached_input_tokens"),
                     zero.alias("output_tokens"), zero.alias("thinking_tokens"), F.col("event_id").alias("total_tokens"), F.col("event_id").cast("decimal(18,9)").alias("cost_usd"))


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_tables_are_files_or_folders_of_files(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    spark.range(10, 16).repartition(2).write.parquet(f"{tmp_path}/in/events_late.parquet")
    spark.range(90, 99).write.parquet(f"{tmp_path}/in/orders.parquet")
    st.run_available(st.file_stream(spark, f"{tmp_path}/in", "events"), st.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(16))


def test_ledger_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    ev = split_events(spark, tmp_path / "in")
    live = lambda: usage(stream_of(spark, tmp_path / "in"))
    out = st.stream_daily_ledger(live(), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = ag.daily_ledger(usage(ev)).withColumn("cost_usd", F.col("cost_usd").cast("decimal(38,9)"))
    same(out.withColumn("cost_usd", F.col("cost_usd").cast("decimal(38,9)")), batch)
    again = st.stream_daily_ledger(live(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert again.agg(F.sum("request_count")).first()[0] == ev.count()


def test_late_rows_rebuild_only_their_days(spark, tmp_path):
    ev = split_events(spark, tmp_path / "in")
    st.late_correction(usage(stream_of(spark, tmp_path / "in")), f"{tmp_path}/facts", f"{tmp_path}/ledger", f"{tmp_path}/cp")
    late = ev.where("event_id = 1").withColumn("event_id", F.lit(99_999).cast("long"))
    late.write.parquet(f"{tmp_path}/in/events_9.parquet")
    out = st.late_correction(usage(stream_of(spark, tmp_path / "in")), f"{tmp_path}/facts", f"{tmp_path}/ledger", f"{tmp_path}/cp")
    both = ag.daily_ledger(usage(ev.unionByName(late)))
    key = [*ag.LEDGER_KEYS, "request_count", "total_tokens"]
    same(out.select([F.col(c).cast("string") for c in key]), both.select([F.col(c).cast("string") for c in key]))


def shuffled_events(spark, folder, n=5):
    """Events over n files, dealt so that rows of neighbouring times arrive in any order but within four days."""
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    late = F.pmod(F.xxhash64("event_id"), F.lit(4))
    slice_of = F.least(F.floor((F.dayofmonth("ts") - 1 + late) / (33 / n)), F.lit(n - 1))
    for i in range(n):
        ev.where(slice_of == i).coalesce(1).write.parquet(f"{folder}/events_{i}.parquet")
    return ev


def settled(spark, fold, path, first):
    st.run_available(fold.changes, st.append_batches(f"{path}/out"), f"{path}/cp")
    return fold.results(spark, f"{path}/out", f"{path}/cp").where(F.col(first).isNotNull())


@pytest.mark.parametrize("files", [split_events, shuffled_events])
def test_silent_stream_equals_batch(spark, tmp_path, files):
    ev = files(spark, tmp_path / "in")
    got = settled(spark, st.silent_runs(stream_of(spark, tmp_path / "in"), "user_id", "ts", 7_200, "5 days"), tmp_path, "last_us")
    batch = rn.silent_gaps(ev.select("user_id", "ts").distinct(), "user_id", "ts", ["ts"], 7_200)
    assert sorted(map(tuple, got.select("key", "last_us", "next_us").collect()), key=str) == sorted(map(tuple, batch.select("user_id", F.unix_micros("ts"), F.unix_micros("next_at")).collect()), key=str)


@pytest.mark.parametrize("files", [split_events, shuffled_events])
def test_incident_stream_equals_batch(spark, tmp_path, files):
    ev = files(spark, tmp_path / "in").withColumn("down", F.col("event_type") == "error")
    live = stream_of(spark, tmp_path / "in").withColumn("down", F.col("event_type") == "error")
    got = settled(spark, st.stream_incidents(live, "user_id", "ts", "down", "event_id", "5 days"), tmp_path, "started_us")
    batch = wn.incident_intervals(ev, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "down")
    assert sorted(map(tuple, got.select("key", "started_us", "resolved_us").collect()), key=str) == sorted(map(tuple, batch.select("user_id", F.unix_micros("started_at"), F.unix_micros("resolved_at")).collect()), key=str)


@pytest.mark.parametrize("files", [split_events, shuffled_events])
def test_pulse_stream_equals_batch(spark, tmp_path, files):
    ev = files(spark, tmp_path / "in")
    got = settled(spark, st.stream_pulses(stream_of(spark, tmp_path / "in"), "user_id", "ts", "event_type", "event_id", "event_id", "5 days"), tmp_path, "phase")
    logs = ev.select(F.col("user_id").alias("run_id"), (F.unix_micros("ts")).alias("t"), "event_id", F.col("event_type").alias("phase"), F.col("event_id").alias("chars"))
    batch = wn.coalesce_pulses(logs, 10**12).select("run_id", "phase", "since", "t", "chars", "pulses")
    assert sorted(map(tuple, got.select("key", "phase", "since_us", "last_us", "value", "pulses").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    assert got.where("is_open").count() == ev.select("user_id").distinct().count()


def write_files(spark, folder, files):
    for i, rows in enumerate(files):
        df = spark.createDataFrame([(k, f"2024-01-01 {t}", x) for k, t, x in rows], "user_id long, t string, x string")
        df.select("user_id", F.to_timestamp("t").alias("ts"), F.col("x").alias("event_type"), F.unix_micros(F.to_timestamp("t")).alias("event_id")).coalesce(1).write.parquet(f"{folder}/events_{i}.parquet")


def test_rows_that_arrive_late_split_a_pulse_and_close_an_incident(spark, tmp_path):
    write_files(spark, tmp_path / "in", [[(1, "10:00:00", "view"), (1, "10:01:00", "view"), (1, "10:04:00", "view"), (1, "10:05:00", "view")], [(1, "10:02:00", "error"), (1, "10:03:00", "error")]])
    got = settled(spark, st.stream_pulses(stream_of(spark, tmp_path / "in"), "user_id", "ts", "event_type", "event_id", "event_id"), tmp_path / "p", "phase")
    assert [(r["phase"], r["pulses"], r["is_open"]) for r in got.orderBy("since_us").collect()] == [("view", 2, False), ("error", 2, False), ("view", 2, True)]
    live = stream_of(spark, tmp_path / "in").withColumn("down", F.col("event_type") == "error")
    got = settled(spark, st.stream_incidents(live, "user_id", "ts", "down", "event_id"), tmp_path / "i", "started_us").collect()
    assert [(r["resolved_us"] - r["started_us"]) // 60_000_000 for r in got] == [2]


def test_silence_that_ends_after_its_timer_is_closed(spark, tmp_path):
    write_files(spark, tmp_path / "in", [[(1, "00:00:00", "a"), (2, "00:00:00", "a")], [(2, "12:00:00", "a")], [(2, "18:00:00", "a"), (1, "22:00:00", "a")]])
    got = settled(spark, st.silent_runs(stream_of(spark, tmp_path / "in"), "user_id", "ts", 180), tmp_path, "last_us")
    hours = lambda us: None if us is None else us // 3_600_000_000 % 24
    assert sorted(((r["key"], hours(r["last_us"]), hours(r["next_us"])) for r in got.collect()), key=str) == sorted([(1, 0, 22), (1, 22, None), (2, 0, 12), (2, 12, 18), (2, 18, None)], key=str)


def test_late_correction_reads_only_the_touched_days(spark, tmp_path):
    split_events(spark, tmp_path / "in")
    st.late_correction(usage(stream_of(spark, tmp_path / "in")), f"{tmp_path}/facts", f"{tmp_path}/ledger", f"{tmp_path}/cp")
    stored = spark.read.parquet(f"{tmp_path}/facts")
    some = stored.select("usage_date").distinct().orderBy("usage_date").limit(2).collect()
    plan = st.facts_of_days(stored, [d[0] for d in some])._jdf.queryExecution().executedPlan().toString()
    assert "usage_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = {f for f in st.facts_of_days(stored, [d[0] for d in some]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert all(any(f"usage_date={d[0]}" in f for d in some) for f in read)


def test_dedup_stream_keeps_first_of_each_key(spark, tmp_path):
    ev = split_events(spark, tmp_path / "in")
    live = stream_of(spark, tmp_path / "in")
    st.run_available(st.stream_dedup(live.unionByName(live), ["event_id"], "ts", "1 day"), st.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == ev.count()


def test_ledger_total_equals_event_total(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    ledger = entry.queries()["e02_daily_ledger"](spark, folder)
    assert ledger.agg(F.sum("request_count")).first()[0] == spark.read.parquet(f"{folder}/events.parquet").count()


def test_state_written_per_turn_follows_the_new_rows(spark, tmp_path):
    """One hot key: a turn must not rewrite what waits from the turns before."""
    files = [[(1, f"10:{m:02d}:{s:02d}", "view") for m in range(i * 2, i * 2 + 2) for s in range(60)] for i in range(5)]
    write_files(spark, tmp_path / "in", files)
    live = st.stream_pulses(stream_of(spark, tmp_path / "in"), "user_id", "ts", "event_type", "event_id", "event_id", "1 hour")
    q = live.changes.writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(st.append_batches(f"{tmp_path}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert len(written) == 5 and max(written) <= 120 + 20
    got = live.results(spark, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert [(r["pulses"], r["is_open"], r["is_final"]) for r in got] == [(600, True, False)]


def test_a_turn_registers_one_timer_per_key_and_appends_blocks(spark, tmp_path):
    """Many rows of few keys: the work on state follows keys and lists, not rows or time buckets."""
    write_files(spark, tmp_path / "in", [[(k, f"{h:02d}:{m:02d}:00", "view") for k in (1, 2) for h in range(10) for m in range(0, 60, 3)]])
    live = st.stream_pulses(stream_of(spark, tmp_path / "in"), "user_id", "ts", "event_type", "event_id", "event_id")
    q = live.changes.writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(st.append_batches(f"{tmp_path}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    first = q.recentProgress[0]["stateOperators"][0]
    assert first["customMetrics"]["numRegisteredTimers"] == 2 and first["numRowsUpdated"] <= 2 * (st.RING + 4)
    got = live.results(spark, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r["key"], r["pulses"], r["is_open"]) for r in got) == [(1, 200, True), (2, 200, True)]
