"""Nearest neighbours by inner product: one vantage-point tree per shard.

Inner products become distances by one more coordinate that lifts every vector of a shard to the same norm, so that the
triangle inequality holds. A branch is left out when its lower bound times the factor `relax` exceeds the distance of the
k-th best so far; factor one is exact search. Equal vectors are one point with its smallest k + 1 ids, folded before the
shuffle, so a vector that very many rows share costs one point per task. Points of equal score are ordered by their
smallest id that is not the query's own. Queries come in blocks, and each block visits every shard; a task holds one shard
and one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128
NO_ID = np.iinfo(np.int64).max


class VantageTree:
    """A tree over the rows of `x` (double). Children know the range of their distances to the vantage point.

    `ids` holds the two smallest ids of each point, `NO_ID` where there is no second.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 7):
        self.ids = ids
        norms = np.einsum("ij,ij->i", x, x)
        self.square = float(norms.max(initial=0.0))
        self.x = x
        self.lifted = np.sqrt(np.maximum(self.square - norms, 0.0))
        self.order = np.arange(len(x))
        self.draw = np.random.default_rng(seed)
        self.root = self._build(0, len(x))

    def _apart(self, rows: np.ndarray, v: int) -> np.ndarray:
        dot = self.x[rows] @ self.x[v] + self.lifted[rows] * self.lifted[v]
        return np.sqrt(np.maximum(2 * self.square - 2 * dot, 0.0))

    def _build(self, low: int, high: int):
        if high - low <= LEAF:
            return (low, high)
        rows = self.order[low:high]
        v = int(rows[self.draw.integers(len(rows))])
        d = self._apart(rows, v)
        sort = np.argsort(d, kind="stable")
        self.order[low:high], d = rows[sort], d[sort]
        half = len(rows) // 2
        return (v, d[0], d[half - 1], d[half], d[-1], self._build(low, low + half), self._build(low + half, high))

    def points_for(self, k: int) -> int:
        """Number of best points that hold the `k` best ids for certain, where ids may stand at several points."""
        times = np.sort(np.unique(self.ids[self.ids != NO_ID], return_counts=True)[1])[::-1]
        return min(len(self.x), 1 + int(times[: k - 1].sum()))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float) -> np.ndarray:
        """Numbers of the k best points found for each query without the ids `own`, best first; -1 where there are fewer."""
        self.q, self.own, self.k, self.relax = q, own, k, relax
        self.norm = np.einsum("ij,ij->i", q, q)
        self.best = np.full((len(q), k), -np.inf)
        self.key = np.full((len(q), k), NO_ID)
        self.point = np.full((len(q), k), -1, np.int64)
        self._visit(self.root, np.arange(len(q)))
        return self.point

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if len(node) == 2:
            points = self.order[node[0] : node[1]]
            score = self.q[rows] @ self.x[points].T
            better = (score >= self.best[rows, -1:]).any(axis=1)
            if not better.any():
                return
            rows, score = rows[better], score[better]
            first, second = self.ids[points].T
            key = np.where(first == self.own[rows, None], second, first)
            score[key == NO_ID] = -np.inf
            points = np.broadcast_to(points, score.shape)
            # Only as many columns are ordered as some query has points that its k-th best does not beat.
            most = int((score >= self.best[rows, -1:]).sum(axis=1).max())
            if most < score.shape[1]:
                some = np.argpartition(-score, most - 1, axis=1)[:, :most]
                score, key, points = (np.take_along_axis(x, some, 1) for x in (score, key, points))
            scores = np.concatenate([self.best[rows], score], axis=1)
            keys = np.concatenate([self.key[rows], key], axis=1)
            found = np.concatenate([self.point[rows], points], axis=1)
            top = np.lexsort((keys, -scores))[:, : self.k]
            self.best[rows] = np.take_along_axis(scores, top, 1)
            self.key[rows] = np.take_along_axis(keys, top, 1)
            self.point[rows] = np.take_along_axis(found, top, 1)
            return
        v, low_in, high_in, low_out, high_out, inner, outer = node
        d = np.sqrt(np.maximum(self.norm[rows] + self.square - 2 * (self.q[rows] @ self.x[v]), 0.0))
        first = d <= (high_in + low_out) / 2
        sides = ((first, inner, low_in, high_in), (~first, outer, low_out, high_out))
        for near, child, _, _ in sides:
            self._visit(child, rows[near])
        for near, child, low, high in sides:
            far = rows[~near]
            reach = np.sqrt(np.maximum(self.norm[far] + self.square - 2 * self.best[far, -1], 0.0))
            bound = np.maximum(np.maximum(low - d[~near], d[~near] - high), 0.0)
            # Ties pass: distances near zero are known to about 1e-8 of the norms.
            self._visit(child, far[bound * self.relax <= reach + 1e-7 * np.sqrt(self.norm[far] + self.square)])


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None if it is null, empty, zero, or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for value in column:
        x = np.array(value.values.to_numpy(zero_copy_only=False), np.float64) if value.is_valid else np.empty(0)
        out.append(x if len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _split(vectors: DataFrame, k: int, every: int, shards: int, block: int) -> DataFrame:
    """Index points (`kind` 0) and query blocks (`kind` 1): `home`, `kind`, `ids`, `data`, `dim`."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        waiting: dict[int, list[tuple[int, bytes]]] = {}
        names = ["home", "kind", "ids", "data", "dim"]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def packed(dim, part):
            return (0, 1, [i for i, _ in part], b"".join(x for _, x in part), dim)

        for batch in batches:
            points: dict[bytes, set[int]] = {}
            for i, x in zip(batch.column(0).to_pylist(), _usable(batch.column(1))):
                if x is None or i is None:
                    continue
                raw = x.tobytes()
                ids = points.setdefault(raw, set())
                if i % every == 0 and i not in ids:
                    waiting.setdefault(len(x), []).append((i, raw))
                ids.add(i)
            rows = [(xxh64_intdigest(raw) % shards, 0, sorted(ids)[: k + 1], raw, len(raw) // 8) for raw, ids in points.items()]
            for dim, part in waiting.items():
                while len(part) >= block:
                    rows.append(packed(dim, part[:block]))
                    del part[:block]
            if rows:
                yield made(rows)
        if rest := [packed(dim, part) for dim, part in waiting.items() if part]:
            yield made(rest)

    return vectors.mapInArrow(fold, "home int, kind int, ids array<long>, data binary, dim int")


def _searched(k: int, relax: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, points, tree = None, {}, None
        names, types = ["query_id", "found"], [pa.int64(), pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))]
        for batch in batches:
            for dim, shard, kind, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, shard) != home:
                    home, points, tree = (dim, shard), {}, None
                if kind == 0:
                    points[data] = sorted({*points[data], *ids})[: k + 1] if data in points else ids
                    continue
                if tree is None and points:
                    members = list(points.values())
                    smallest = np.array([(m[0], m[1] if len(m) > 1 else NO_ID) for m in members], np.int64)
                    tree = VantageTree(np.frombuffer(b"".join(points), np.float64).reshape(-1, dim), smallest)
                    points, wide = {}, tree.points_for(k)
                if tree is None:
                    continue
                q = np.frombuffer(data, np.float64).reshape(-1, dim)
                near = tree.search(q, np.array(ids, np.int64), wide, relax)
                best: dict[int, dict[int, float]] = {}
                for n, own in enumerate(ids):
                    row = near[n][near[n] >= 0]
                    score = np.einsum("d,kd->k", q[n], tree.x[row])
                    at = best.setdefault(own, {})
                    for p, v in zip(row.tolist(), score.tolist()):
                        for i in members[p]:
                            if i != own and v > at.get(i, -np.inf):
                                at[i] = v
                rows = []
                for at in best.values():
                    each = sorted((-v, i) for i, v in at.items())[:k]
                    rows.append([{"score": -v, "vec_id": i} for v, i in each])
                yield pa.RecordBatch.from_arrays([pa.array(list(best), types[0]), pa.array(rows, types[1])], names)

    return run


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, relax: float = 1.1, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 8_192, block: int = 256,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: for each row whose id is divisible by `every`, its `k` nearest
    among all other rows, by inner product in double precision; ties go to the smaller id.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors are only
    compared with vectors of their length. Repeated rows count once. Rows of one id with different vectors are all searched
    and all queried; the id is ranked once, by its best score, and a query leaves out all rows of its own id. With fewer candidates than `k` all are returned; an empty table gives an empty result. Other columns are
    ignored. `relax` at 1 searches exactly; recall at the default was measured (see README).
    """
    own = vectors.select(vectors[id_col].cast("long").alias("i"), vectors[vector_col].cast("array<double>").alias("x"))
    shards = max(1, -(-vectors.count() // shard_rows))
    split = _split(own, k, every, shards, block)
    homes = F.when(F.col("kind") == 0, F.array("home")).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))
    placed = split.select("dim", F.explode(homes).alias("shard"), "kind", "ids", "data")
    dealt = placed.repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = dealt.mapInArrow(_searched(k, relax), "query_id long, found array<struct<score:double,vec_id:long>>")
    each = found.select("query_id", F.inline("found")).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
