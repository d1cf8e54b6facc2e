"""Near-duplicate classes by SimHash fingerprints, found with vantage-point trees.

On 64 nearly uniform bits one tree over the whole distance hardly prunes: a query ball of radius 4 reaches over the
median of about two thirds of all nodes. The top of the index is therefore a forest. Each tree measures the distance to
its vantage point on its own block of bits, and a cell holds the fingerprints that differ from the vantage point in the
same bits of the block. Block distances add up to the whole distance, so a pair within `radius` is within
`radius // trees` in one block at least: a fingerprint visits its home cell and, where that share is not zero, the cells
within reach across the border. Five trees for radius 4 need no visits. Inside a cell a vantage-point tree on the whole
distance is joined with itself: halves are compared only between points whose distances to the vantage point allow it.

A cell gives a spanning forest of its links, never all pairs. Cells above `cell_rows` are dealt into chunks, and each pair
of chunks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import components, saved, slices

LEAF = 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit majority of the XXH64 values of all `words`-word shingles, as a signed integer; zero without words."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # on bytes, only ASCII letters and blanks
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(tokens) - words + 1)].tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, rows: int = 512) -> DataFrame:
    """`id_col`, `fp` (long) of every row, over the whole text. A null text counts as empty and has fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, rows):
            marks = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


class _Forest:
    """Spanning links among points with the same owner; links inside a known class are not looked at again."""

    def __init__(self, points: np.ndarray, radius: int):
        self.x, self.radius, self.parent = points, radius, np.arange(len(points))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            higher = self.parent[up]
            if (higher == up).all():
                self.parent[at] = up
                return up
            up = higher

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            r, s = self.root(i), self.root(j)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                self.links.append((i, j))

    def block(self, a: np.ndarray, b: np.ndarray) -> None:
        """All links between two sets, in row blocks; classes are joined step by step, one link per row and step."""
        for at in range(0, len(a), LEAF):
            rows = a[at : at + LEAF]
            ra, rb = self.roots(rows), self.roots(b)
            if len(np.unique(np.concatenate([ra, rb]))) == 1:
                continue
            near = np.bitwise_count(self.x[rows][:, None] ^ self.x[b][None, :]) <= self.radius
            while True:
                open_ = near & (self.roots(rows)[:, None] != self.roots(b)[None, :])
                hit = np.flatnonzero(open_.any(axis=1))
                if not len(hit):
                    break
                self.link(rows[hit], b[open_[hit].argmax(axis=1)])

    def inside(self, at: np.ndarray) -> None:
        """Self-join of a vantage-point tree: the first point is the vantage point, the median distance splits."""
        while len(at) > LEAF:
            d = np.bitwise_count(self.x[at] ^ self.x[at[0]]).astype(np.int64)
            close = d <= self.radius
            self.link(np.full(int(close.sum()), at[0]), at[close])
            mu = np.partition(d, len(d) // 2)[len(d) // 2]
            if mu == d.max():
                mu -= 1
            inner, outer = d <= mu, d > mu
            if not inner.any():
                break
            self.between(at[inner & (d > mu - self.radius)], at[outer & (d <= mu + self.radius)])
            small, large = sorted((at[inner], at[outer]), key=len)
            self.inside(small)
            at = large
        self.block(at, at)

    def between(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join of two sets by a common vantage point; only borders are compared across it."""
        if len(a) * len(b) <= 4 * LEAF * LEAF or min(len(a), len(b)) <= LEAF // 4:
            if len(a) and len(b):
                self.block(a, b)
            return
        r = self.radius
        da, db = (np.bitwise_count(self.x[v] ^ self.x[a[0]]).astype(np.int64) for v in (a, b))
        mu = int(np.median(db))
        if mu == max(da.max(), db.max()):
            mu -= 1
        sides = [(a[da <= mu], b[db <= mu]), (a[da > mu], b[db > mu]), (a[(da <= mu) & (da > mu - r)], b[(db > mu) & (db <= mu + r)]), (a[(da > mu) & (da <= mu + r)], b[(db <= mu) & (db > mu - r)])]
        if sum(len(s) * len(t) for s, t in sides) > 0.9 * len(a) * len(b):  # nothing to prune
            self.block(a, b)
            return
        for s, t in sides:
            self.between(s, t)


def cell_links(cells: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell; rows are sorted by cell."""
    left, right = [], []
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    size = np.diff(np.r_[first, len(cells)])
    small = np.repeat(size <= 48, size)
    for step in range(1, int(size[size <= 48].max(initial=0))):
        i = np.flatnonzero(small[:-step] & (cells[:-step] == cells[step:]))
        if not len(i):
            break
        hit = i[np.bitwise_count(points[i] ^ points[i + step]) <= radius]
        left.append(points[hit]), right.append(points[hit + step])
    for start, many in zip(first[size > 48], size[size > 48]):
        own = np.unique(points[start : start + many])
        forest = _Forest(own, radius)
        forest.inside(np.arange(len(own)))
        if forest.links:
            pairs = np.array(forest.links)
            left.append(own[pairs[:, 0]]), right.append(own[pairs[:, 1]])
    empty = [np.empty(0, points.dtype)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _blocks(trees: int) -> list[tuple[int, int]]:
    cuts = [round(64 * k / trees) for k in range(trees + 1)]
    return list(zip(cuts, cuts[1:]))


def _visited(cell: Column, width: int, reach: int) -> Column:
    """The cell itself and all cells within `reach` bits of it."""
    found = F.array(cell)
    for _ in range(reach):
        found = F.array_distinct(F.flatten(F.transform(found, lambda c: F.concat(F.array(c), F.array(*[c.bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(width)])))))
    return found


def _named(cells: Column, tree: int) -> Column:
    return F.transform(cells, lambda cell: F.xxhash64(F.lit(tree), cell))


def links(points: DataFrame, radius: int = 4, trees: int | None = None, cell_rows: int = 20_000, vantage: int = 0x5DEECE66D1B2A397) -> DataFrame:
    """Links `a`, `b` that connect the same classes as all pairs of the column `fp` within `radius` bits do.

    `points` holds distinct fingerprints. `trees` defaults to `radius + 1`; fewer trees mean smaller cells and visits
    across cell borders.
    """
    trees = trees or radius + 1
    rows = []
    for number, (low, high) in enumerate(_blocks(trees)):
        mask = (1 << (high - low)) - 1 if trees > 1 else -1
        bits = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.lit(vantage)), low).bitwiseAND(F.lit(mask).cast("long"))
        rows.append(_named(_visited(bits, high - low, radius // trees), number))
    placed = points.select("fp", F.explode(F.concat(*rows)).alias("cell"))
    large = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("chunks")).where("chunks > 1")
    placed = placed.join(large, "cell", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
    placed = placed.withColumn("other", F.explode(others))
    task = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = placed.select(F.when(F.col("chunks").isNull(), F.col("cell")).otherwise(task).alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        kept_cells, kept_points = np.empty(0, np.int64), np.empty(0, np.uint64)

        def made(c, p):
            a, b = cell_links(c, p, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            c = np.concatenate([kept_cells, batch.column(0).to_numpy()])
            p = np.concatenate([kept_points, batch.column(1).to_numpy().view(np.uint64)])
            whole = np.searchsorted(c, c[-1]) if len(c) else 0  # the last cell may go on in the next batch
            if whole:
                yield made(c[:whole], p[:whole])
            kept_cells, kept_points = c[whole:], p[whole:]
        if len(kept_cells):
            yield made(kept_cells, kept_points)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, trees: int | None = None) -> DataFrame:
    """`id_col`, `fp`, `component_id` of every row: the smallest id among the rows reachable by links of at most `radius`
    differing bits, its own included.

    Texts without words (null or empty too) have fingerprint zero and are linked like any other. Repeated rows stay and
    share a class. Null ids take part and stay null; a class of null ids only has a null `component_id`. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    marked = saved(fingerprints(docs, id_col, text_col, words), "fingerprints").withColumnRenamed(id_col, "id")
    own = marked.groupBy("fp").agg(F.min("id").alias("least"))
    classes = components(links(own.select("fp"), radius, trees))
    members = own.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    result = marked.join(members.join(named, "root").select("fp", "component_id"), "fp")
    return result.select(F.col("id").alias(id_col), "fp", "component_id")
