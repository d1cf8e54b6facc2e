"""Helpers shared by the operators of this folder: shared scratch tables and connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgrain.session import checkpoint_dir

#: Words are runs of characters other than the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


#: Tables written while `settled` makes something, to be removed when it stands.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a table in the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, as a saved table; the tables and shuffles made on the way are let go.

    Only tables that `saved` has written inside `make` are removed, and only once the result is stored.
    """
    inside: list[str] = []
    token = _made.set(inside)
    try:
        result = make()
        path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        result.write.parquet(path)
        schema = result.schema
    finally:
        _made.reset(token)
    del result
    for old in inside:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    # Spark removes shuffle files once the driver has forgotten the frames that use them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if (outer := _made.get()) is not None:
        outer.append(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterable, rows: int):
    """Arrow batches of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an edge list with columns `a`, `b` (any one orderable type; nulls and loops are ignored).

    Returns `node`, `root` for every node that has a link, `root` being the smallest node of its component. Large-star
    and small-star steps alternate until the set of edges no longer changes; each round is written to the shared folder.
    A hub costs one row per neighbour: minima are partial aggregates, and the joins back carry one row per node on one
    side, so Spark can split the hub's rows.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = saved(now, name), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = saved(small.select("e.*").where("a <> b").distinct(), name)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class KnownWords:
    """Ids of words seen before by this worker, so that each word is encoded once; starts anew beyond `limit` words."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.parts, self.filled = [np.empty(0, np.int32)], 0
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _add(self, fresh: list[str]) -> None:
        ids, count = self.encode(fresh)
        before, n = len(self.index), len(self.index) + len(fresh)
        if n > len(self.lens):
            more = np.zeros(max(n, 2 * len(self.lens)) - len(self.lens), np.int64)
            self.starts, self.lens = np.concatenate([self.starts, more]), np.concatenate([self.lens, more])
        self.lens[before:n] = count
        self.starts[before:n] = self.filled + np.cumsum(count) - count
        self.index.update(zip(fresh, range(before, n)))
        self.parts.append(ids)
        self.filled += len(ids)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each given as its words, in one flat array, and how many each text has."""
        if len(self.index) > self.limit:
            self._reset()
        known = self.index
        fresh = list(set(chain.from_iterable(texts)).difference(known))
        if fresh:
            self._add(fresh)
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        sizes = [len(words) for words in texts]
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        lens = self.lens[at]
        before = np.cumsum(lens) - lens
        flat = self.parts[0][np.arange(lens.sum()) + np.repeat(self.starts[at] - before, lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *sizes])]
        return flat, np.diff(ends)
