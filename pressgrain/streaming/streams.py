"""Structured Streaming forms of the incremental operators.

Additive results (ledgers, counters) are written as one partial result per micro-batch under `batch_id=N`; a retried
batch overwrites its own folder, so every batch counts exactly once without keyed state. Operators that need order per
key append rows to list states per time bucket until the watermark has passed them, and keep one small value besides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pressgrain.operators import tables
from pressgrain.operators.aggregates import LEDGER_KEYS, TOKENS, ledger_keys, ledger_measures


def file_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of the parquet files of one table in a folder; an entry named after the table is a file or a folder of files."""
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    entries = f"{folder}/{table}*.parquet"
    schema = spark.read.parquet(entries).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(entries)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; a restart goes on where the checkpoint ends."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sink


def stream_daily_ledger(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Daily usage ledger kept as partial sums per micro-batch; returns the merged ledger."""
    def sink(df: DataFrame, batch_id: int) -> None:
        part = ledger_keys(df).groupBy(*LEDGER_KEYS).agg(*ledger_measures())
        append_batches(path)(part, batch_id)

    run_available(stream, sink, checkpoint)
    return merge_ledger(stream.sparkSession.read.parquet(path))


def merge_ledger(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("request_count", "error_count", *TOKENS, "cost_usd")]
    return parts.groupBy(*LEDGER_KEYS).agg(*sums, F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"))


def facts_of_days(stored: DataFrame, days: Sequence) -> DataFrame:
    """Stored facts of some days; a filter on the partition column, so other days are not read."""
    return stored.where(F.col("usage_date").isin(*days)).drop("batch_id")


def late_correction(stream: DataFrame, facts_path: str, ledger_path: str, checkpoint: str) -> DataFrame:
    """Ledger partitioned by day; each batch stores its facts and rebuilds only the days it touches, late ones included."""
    spark = stream.sparkSession

    def sink(df: DataFrame, batch_id: int) -> None:
        facts = ledger_keys(df)
        facts.write.mode("overwrite").partitionBy("usage_date").parquet(f"{facts_path}/batch_id={batch_id}")
        stored = spark.read.schema(facts.schema.add("batch_id", "long")).parquet(facts_path)
        days = stored.where(F.col("batch_id") == batch_id).select("usage_date").distinct().collect()  # calendar days of a batch
        touched = facts_of_days(stored, [d[0] for d in days])
        tables.write_partitions(touched.groupBy(*LEDGER_KEYS).agg(*ledger_measures()), ledger_path, "usage_date")

    run_available(stream, sink, checkpoint)
    return spark.read.parquet(ledger_path)


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row per key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def _with_micros(stream: DataFrame, key: str, ts: str, cols: Sequence[str]) -> DataFrame:
    return stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("us"), *cols)


RING = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Buckets(StatefulProcessor):
    """Keeps each key's rows in a ring of list states, one per time bucket, until the watermark has passed the bucket.

    New rows are appended to the lists of their buckets, as one block of columns per list and turn, and nothing else is
    written but the earliest bucket that waits in each list. One timer per key stands at the end of the earliest of all. It folds
    every bucket that the watermark has passed, in event-time order, into one small value, puts out what is final, and
    empties the lists; lists that hold only later buckets are not read.
    """

    def __init__(self, fold: Callable, width_us: int, row: str, value: str, out: Sequence[str]):
        self.fold, self.width, self.row, self.value, self.out = fold, width_us, row, value, list(out)

    def init(self, handle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", self.value)
        self.due = handle.getValueState("due", ", ".join(f"b{i} long" for i in range(RING)))
        self.lists = [handle.getListState(f"rows_{i}", _blocks(self.row)) for i in range(RING)]

    def _wait(self, due) -> None:
        """Keep the earliest bucket of each list and stand a timer at the end of the earliest of all."""
        waiting = [b for b in due if b is not None]
        if waiting:
            self.due.update(tuple(due))
            self.handle.registerTimer((min(waiting) + 1) * self.width // 1000)
        else:
            self.due.clear()

    def handleInputRows(self, key, rows, timerValues):
        known, fresh = self.due.get(), {}
        due = list(known) if known is not None else [None] * RING
        for batch in rows:
            us = batch["us"].tolist()
            for at, row in zip(us, zip(*(batch[c.split(" ")[0]].tolist() for c in self.row.split(", ")))):
                fresh.setdefault(at // self.width % RING, []).append(_plain(row))
        for slot, own in fresh.items():
            self.lists[slot].appendValue(_block(own))
            first = min(r[0] for r in own) // self.width
            due[slot] = first if due[slot] is None else min(first, due[slot])
        self._wait(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        known = self.due.get()
        if known is None:
            return
        # Buckets up to this one have ended.
        last = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 // self.width - 1
        due, own = list(known), []
        for slot, first in enumerate(due):
            if first is None or first > last:
                continue
            later = []
            for block in self.lists[slot].get():
                for r in zip(*block):
                    (own if r[0] // self.width <= last else later).append(r)
            # A row far ahead of the watermark shares its list with an earlier bucket.
            if later:
                self.lists[slot].put([_block(later)])
            else:
                self.lists[slot].clear()
            due[slot] = min(r[0] for r in later) // self.width if later else None
        if not own:
            return
        self._wait(due)
        before = _known(self.folded.get())
        value, final = self.fold(before, sorted(own))
        if value is not None:
            self.folded.update(value)
        elif before is not None:
            self.folded.clear()
        if final:
            yield pd.DataFrame([(key[0], *f) for f in final], columns=["key", *self.out])

    def close(self) -> None:
        pass


def _blocks(row: str) -> str:
    """The type of a block of rows: an array per column."""
    return ", ".join("{} array<{}>".format(*c.split(" ")) for c in row.split(", "))


def _block(rows: Sequence[tuple]) -> tuple:
    return tuple(list(c) for c in zip(*rows))


def _plain(row: tuple) -> tuple:
    """A row's values as Python's own types, with None for what is missing."""
    return tuple(None if x is None or x != x else x.item() if hasattr(x, "item") else x for x in row)


def _known(row) -> tuple | None:
    """A stored value; None if nothing was stored."""
    return None if row is None or all(x is None for x in row) else tuple(row)


def _followed(fold: Callable, still_open: Callable, n_known: int, out: str) -> Callable:
    """Arrow batches of (key, waits, folded value, row), sorted, to what would follow for each key if nothing else came."""
    def run(batches):
        from itertools import chain, groupby

        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        types = [pa.int64(), *(kinds[c.split(" ")[1]] for c in out.split(", "))]
        names = ["key", *(c.split(" ")[0] for c in out.split(", "))]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        rows, found = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), []
        for key, own in groupby(rows, lambda r: r[0]):
            first = next(own)
            before = None if first[1] else _known(first[2:2 + n_known])
            waiting = chain([first], own) if first[1] else own
            after, soon = fold(before, (r[2 + n_known:] for r in waiting))
            found += [(key, *f) for f in [*soon, *still_open(after)]]
            if len(found) >= 10_000:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    return run


@dataclass
class EventTimeFold:
    """A fold of each key's rows in event-time order. `changes` is the stream of final results; `results` adds those that
    are still open, read from the state of the stream's checkpoint."""

    rows: DataFrame
    fold: Callable
    still_open: Callable
    width_us: int
    row: str
    value: str
    out: str

    @property
    def changes(self) -> DataFrame:
        spark = self.rows.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        # Python's state takes no nulls in the names of a row; values may be null.
        names = [c.split(" ")[0] for c in self.out.split(", ")]
        step = _Buckets(self.fold, self.width_us, self.row, self.value, names)
        return self.rows.groupBy("key").transformWithStateInPandas(step, f"key long, {self.out}", outputMode="append", timeMode="EventTime")

    def open_results(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """What would follow if nothing else came: the rows that still wait folded in, and what is open after them."""
        state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        names = [c.split(" ")[0] for c in self.row.split(", ")]
        waiting = None
        for i in range(RING):
            part = state(f"rows_{i}").select("key.key", F.inline(F.arrays_zip(*(F.col(f"list_element.{c}") for c in names))).alias(*names))
            waiting = part if waiting is None else waiting.unionByName(part)
        known = [c.split(" ")[0] for c in self.value.split(", ")]
        values = state("folded").select("key.key", *(F.col(f"value.{c}").alias(c) for c in known))
        # A key's folded value, then its rows in event-time order; one task goes through many keys, row by row.
        own = ["key", "waits", *(f"value_{c}" for c in known), *(f"row_{c}" for c in names)]
        values = values.toDF("key", *(f"value_{c}" for c in known)).withColumn("waits", F.lit(False))
        both = waiting.toDF("key", *(f"row_{c}" for c in names)).withColumn("waits", F.lit(True)).unionByName(values, allowMissingColumns=True)
        dealt = both.select(*own).repartition("key").sortWithinPartitions("key", "waits", *own[2 + len(known):])
        return dealt.mapInArrow(_followed(self.fold, self.still_open, len(known), self.out), f"key long, {self.out}")

    def results(self, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
        """Final rows that the stream has written to `path`, and the open ones."""
        final = spark.read.parquet(path).drop("batch_id").withColumn("is_final", F.lit(True))
        return final.unionByName(self.open_results(spark, checkpoint).withColumn("is_final", F.lit(False)))


def _seconds(delay: str) -> float:
    """Length of an interval of fixed length such as `10 minutes`."""
    number, unit = delay.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}[unit.rstrip("s")]


def _in_event_time(rows: DataFrame, delay: str, fold: Callable, still_open: Callable, row: str, value: str, out: str) -> EventTimeFold:
    """Buckets are a quarter of the delay wide, so that the ring holds all rows up to one delay ahead of the watermark."""
    width = max(1_000, int(_seconds(delay) * 250_000) // 1_000 * 1_000)
    return EventTimeFold(rows.withWatermark("ts", delay), fold, still_open, width, row, value, out)


def thin_beats(beats: DataFrame, limit_us: int) -> DataFrame:
    """Heartbeats (key, ts, us) thinned before the shuffle without changing any silence longer than the limit.

    Of each Arrow batch the first and the last beat per key and time slice of the limit's width stay. A longer silence
    ends one slice and begins another, so both its ends stay; what goes lies between two beats less than the limit apart.
    """
    def thin(batches):
        for batch in batches:
            by = [batch["key"], batch["us"] // limit_us]
            us = batch.groupby(by)["us"]
            yield batch[(batch["us"] == us.transform("min")) | (batch["us"] == us.transform("max"))]

    return beats.mapInPandas(thin, "key long, ts timestamp, us long")


def silent_runs(stream: DataFrame, key: str, ts: str, threshold_s: int = 180, delay: str = "10 minutes") -> EventTimeFold:
    """(key, last_us, next_us) per silence: between two heartbeats further apart than the threshold, and after the last
    heartbeat of a key (null)."""
    limit = threshold_s * 1_000_000

    def fold(last, rows):
        closed = []
        for (us,) in rows:
            if last is not None and us - last[0] > limit:
                closed.append((last[0], us))
            last = (us,)
        return last, closed

    rows = thin_beats(_with_micros(stream, key, ts, []), limit)
    return _in_event_time(rows, delay, fold, lambda last: [] if last is None else [(last[0], None)], "us long", "last_us long", "last_us long, next_us long")


def stream_pulses(stream: DataFrame, key: str, ts: str, phase: str, value: str, order: str, delay: str = "10 minutes") -> EventTimeFold:
    """Merged pulses: phase, since, last time, last value, count and whether the pulse may go on (`is_open`)."""
    def fold(current, rows):
        closed = []
        for us, _, p, v in rows:
            if current and current[0] == p:
                current = (p, current[1], us, v, current[4] + 1)
            else:
                if current:
                    closed.append((*current, False))
                current = (p, us, us, v, 1)
        return current, closed

    rows = _with_micros(stream, key, ts, [F.col(order).alias("position"), F.col(phase).alias("phase"), F.col(value).alias("value")])
    kept = "phase string, since_us long, last_us long, value long, pulses long"
    row = "us long, position long, phase string, value long"
    return _in_event_time(rows, delay, fold, lambda current: [(*current, True)] if current else [], row, kept, f"{kept}, is_open boolean")


def stream_incidents(stream: DataFrame, key: str, ts: str, down: str, order: str, delay: str = "10 minutes") -> EventTimeFold:
    """(key, started_us, resolved_us) per incident, from the first down row to the next up row (null while open)."""
    def fold(started, rows):
        closed = []
        for us, _, is_down in rows:
            if is_down and started is None:
                started = (us,)
            elif not is_down and started is not None:
                closed.append((started[0], us))
                started = None
        return started, closed

    rows = _with_micros(stream, key, ts, [F.col(order).alias("position"), F.col(down).alias("down")])
    out = "started_us long, resolved_us long"
    return _in_event_time(rows, delay, fold, lambda started: [] if started is None else [(started[0], None)], "us long, position long, down boolean", "started_us long", out)


def resume_analysis(articles: DataFrame, done: DataFrame, key: str, stage_hash: str) -> DataFrame:
    """Articles whose (id, stage hash) has not been processed; an unchanged one is skipped, a changed one returns."""
    return articles.join(done.select(key, stage_hash), [key, stage_hash], "left_anti")


def signal_rows(pages: DataFrame, pack, aliases: DataFrame) -> DataFrame:
    """Signals of pages as a stateless stream: pages through extraction and prefilter, their words joined to the aliases.

    One row per page with families and reject reason and a null company, and one per alias that its text holds as a whole
    phrase. The aliases are the static side of a stream-static join on their longest word.
    """
    from pressgrain.functions.text import norm_text
    from pressgrain.operators.entities import alias_words
    from pressgrain.operators.rules import prefilter
    from pressgrain.scale import broadcast_if_small
    from pressgrain.sources.pages import extract_articles

    articles = extract_articles(pages).withColumnRenamed("page_id", "doc_id")
    articles = articles.withColumn("norm", norm_text(F.concat_ws("\n", "title", "content")))
    rows = prefilter(articles, pack, keep=["norm"]).drop("companies")
    # The empty word stands for the page itself.
    words = rows.withColumn("word", F.explode(F.array_union(F.array(F.lit("")), F.split("norm", " "))))
    met = words.join(broadcast_if_small(alias_words(aliases)), "word", "left")
    held = F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" ")))
    return met.where((F.col("word") == "") | held).select("doc_id", "families", "reject", "company")


def stream_signals(pages: DataFrame, pack, aliases: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Families, companies and reject reason per page of a stream, as `prefilter` gives them for a batch of pages."""
    run_available(signal_rows(pages, pack, aliases), append_batches(path), checkpoint)
    rows = pages.sparkSession.read.parquet(path)
    return rows.groupBy("doc_id").agg(F.first("families").alias("families"), F.first("reject").alias("reject"), F.array_sort(F.collect_set("company")).alias("companies"))


def stream_backlog(jobs: DataFrame, as_of, path: str, checkpoint: str, stale_hours: int = 2) -> DataFrame:
    """Jobs and stale jobs per status and attempt, kept as partial counts per micro-batch."""
    stale = (F.col("status") == "running") & (F.col("updated_at") < as_of - F.expr(f"interval {stale_hours} hours"))

    def sink(df: DataFrame, batch_id: int) -> None:
        part = df.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("stale"))
        append_batches(path)(part, batch_id)

    run_available(jobs, sink, checkpoint)
    parts = jobs.sparkSession.read.parquet(path)
    return parts.groupBy("status", "attempts").agg(F.sum("n").alias("n"), F.sum("stale").alias("stale"))
