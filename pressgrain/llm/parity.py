"""Documents of similar shingle sets by parity sketches: an exact Jaccard join without all pairs.

Each shingle toggles one bit of its document's sketch. The sketches of two documents then differ in at most as many bits
as their sets differ in shingles, so a distance above what the similarity allows excludes a pair. Two sets of a and b
shingles are similar enough only if they differ in at most (a + b)(1 - s) / (1 + s).

Sizes are cut into bands as wide as similar sets can differ; a document takes part in its own band and in the one below.
In a band of allowed distance D the sketch has D + spare blocks, of which similar documents share `spare` at least: equal
blocks are the join keys. A block is kept as the exclusive or of 64-bit values of its set bits, that is, very wide and
thinly filled. Blocks of fewer than `thin` shingles say little and are no keys. Two similar documents can lack a common
key only if each has `spare` such blocks; those poor in keys are hashed anew, and again, and at last give all blocks.

Equal sets are one document. In each bucket of a key every member is compared with the smallest one, twice. In
buckets that this leaves in different classes, sketch distances are computed in blocks of pairs: first only as many near
pairs go on as would join the classes, in the end all that still lie between classes. Pairs that go on are verified on the
sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import components, saved, slices

SHINGLE, SEEDS = 4, 3
PART, WHOLE = 85, 100  # the similarity as a fraction of whole numbers
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * ODD[0]
    x = (x ^ (x >> np.uint64(32))) * ODD[1]
    return x ^ (x >> np.uint64(29))


def bands(most: int, part: int = PART, whole: int = WHOLE) -> np.ndarray:
    """First sizes of the bands up to the one that holds `most`: sizes of similar sets are in one band or in neighbours."""
    found = [1]
    while found[-1] <= most:
        found.append(-(-found[-1] * whole // part))
        if found[-1] == found[-2]:
            found[-1] += 1
    return np.array(found, np.int64)


def allowed(total: np.ndarray, part: int = PART, whole: int = WHOLE) -> np.ndarray:
    """Most shingles in which two similar sets of `total` shingles together can differ."""
    return total * (whole - part) // (whole + part)


def plan(starts: np.ndarray, part: int = PART, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per band: blocks, blocks that similar documents share at least, and the fewest shingles of a block that is a key."""
    largest = np.append(starts[1:], starts[-1] * whole // part + 1) - 1
    distance = allowed(largest + largest * whole // part, part, whole)
    thin = np.where(largest < 60, 1, 2)
    # As many spare blocks as leave about one in a hundred of the band's smallest sets poor.
    spare, short = np.full(len(starts), 2), np.ones(len(starts), bool)
    while short.any():
        spare[short] += 1
        blocks = distance + spare
        mean = starts / blocks
        bad = np.exp(-mean) * np.where(thin == 1, 1, 1 + mean)
        short &= blocks * bad + 2.3 * np.sqrt(blocks * bad * (1 - bad)) > spare
        short &= spare < distance + 2
    return distance + spare, spare, thin


def shingle_sets(texts: list[str | None], words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as sorted 64-bit hashes in one array, and how many each text has.

    Words are runs other than the six ASCII blanks, A-Z in lower case; a text of fewer words is one shingle, of none has
    none.
    """
    from xxhash import xxh3_64_intdigest

    tokens = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.fromiter((h for own in tokens for h in map(xxh3_64_intdigest, own)), np.uint64, int(sizes.sum()))
    many = np.where(sizes == 0, 0, np.maximum(sizes - words + 1, 1))
    begins = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(np.cumsum(sizes) - sizes - begins, many)
    left = np.repeat(np.minimum(sizes, words), many)
    room = np.concatenate([flat, np.zeros(words, np.uint64)])
    total = left.astype(np.uint64)
    for k in range(words):
        total = _mix(total + np.where(k < left, room[at + k], np.uint64(0)), k + 1)
    owner = np.repeat(np.arange(len(tokens)), many)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[first], np.bincount(owner[first], minlength=len(tokens))


def _blocks(x: np.ndarray, sizes: np.ndarray, band: np.ndarray, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Block sums of sets under one seed: owner, block, shingles in it, exclusive or of their values. Empty ones are left out."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    x = _mix(x, 100 + seed) if seed else x
    block = ((x >> np.uint64(32)) * blocks[band][owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    if seed:
        order = np.lexsort((block, owner))
        x, block = x[order], block[order]
    edge = np.ones(len(x), bool)
    edge[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(edge)
    if not len(starts):
        return owner, block, starts, x
    return owner[starts], block[starts], np.diff(np.append(starts, len(x))), np.bitwise_xor.reduceat(_mix(x, 50), starts)


def keys(x: np.ndarray, sizes: np.ndarray, part: int = PART, whole: int = WHOLE, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets given by sorted hashes: (owner, key). Similar sets that are not equal share one key at least."""
    starts = bands(int(sizes.max(initial=1)), part, whole)
    blocks, spare, thin = plan(starts, part, whole)
    own = np.searchsorted(starts, sizes, "right") - 1
    found = []
    for below in (0, 1):  # the own band, and the one below if a similar set can be there
        band = own - below
        takes = (sizes > 0) & (band >= 0)
        takes &= (below == 0) | (-(-sizes * part // whole) < starts[np.minimum(band + 1, len(starts) - 1)])
        takes &= blocks[band] > spare[band]  # no difference is allowed: only equal sets are similar
        asks = np.flatnonzero(takes)
        for seed in range(seeds):
            if not len(asks):
                break
            picked = np.zeros(len(sizes), bool)
            picked[asks] = True
            owner, block, count, value = _blocks(x[np.repeat(picked, sizes)], sizes[asks], band[asks], blocks, seed)
            label = band[asks]
            thick = count >= thin[label[owner]]
            poor = blocks[label] - np.bincount(owner[thick], minlength=len(asks)) >= spare[label]
            if seed == seeds - 1:  # still poor: all blocks are keys, the empty ones too
                rows = np.flatnonzero(poor)
                every = np.concatenate([np.arange(blocks[label[r]]) for r in rows]) if len(rows) else np.empty(0, np.int64)
                whose = np.repeat(rows, blocks[label[rows]])
                width = int(blocks.max())
                known = owner * width + block
                at = np.minimum(np.searchsorted(known, whose * width + every), max(len(known) - 1, 0))
                hit = (known[at] == whose * width + every) if len(known) else np.zeros(len(every), bool)
                also = np.where(hit, value[at], np.uint64(0)) if len(known) else np.zeros(len(every), np.uint64)
                found.append((asks[whose], _key(label[whose], every, also, seed + 1)))
            found.append((asks[owner[thick]], _key(label[owner[thick]], block[thick], value[thick], seed)))
            asks = asks[poor]
    return np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64), np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)


def _key(label: np.ndarray, block: np.ndarray, value: np.ndarray, seed: int) -> np.ndarray:
    return _mix(value ^ _mix((label * 1_000_003 + block).astype(np.uint64), 10 + seed), 30).view(np.int64)


def names(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = _mix(np.add.reduceat(_mix(x, 70), starts) ^ _mix(np.bitwise_xor.reduceat(_mix(x, 80), starts)) ^ sizes[full].astype(np.uint64), 90) | np.uint64(1)
    return out.view(np.int64)


def sketches(x: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches of sets: four bits a shingle and more, a power of two of 64 and more."""
    bits = np.array([max(64, 1 << int(4 * n - 1).bit_length()) for n in sizes.tolist()], np.int64)
    ends = np.cumsum(bits)
    at = (_mix(x, 60) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - bits, sizes)
    raw = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [raw[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist())]


def folded(raw: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit words, folded to `size` bytes: what a sketch of that size would be."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def _marked(id_type: str, words: int, part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies give their keys once
        for batch in slices(batches, 256):
            x, sizes = shingle_sets(batch.column(1).to_pylist(), words)
            name = names(x, sizes)
            fresh = np.zeros(len(sizes), bool)
            for i, own in enumerate(name.tolist()):
                if own not in seen:
                    seen.add(own)
                    fresh[i] = True
            x, own = x[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0)
            owner, key = keys(x, own, part, whole)
            marks = [m if f else None for m, f in zip(sketches(x, own), fresh.tolist())]
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(sizes), lists, pa.array(marks, pa.binary())], ["id", "name", "n", "keys", "sketch"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, name) rows sorted by both: each name of a key once, if the key has other names as well."""

    def kept(key, name, last):
        """Rows of whole runs; the last run waits unless it is the end."""
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        stop = len(key) if last else starts[-1]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1])
        other = np.add.reduceat((~again).astype(np.int64), starts)
        use = ~again & np.repeat(other > 1, np.diff(np.append(starts, len(key))))
        use[stop:] = False
        # Of a run that waits, repeats are known already.
        rest = np.arange(stop, len(key))[~again[stop:]]
        return pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(name[use])], ["key", "name"]), key[rest], name[rest]

    key, name = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            key, name = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([name, batch.column(1).to_numpy()])
            out, key, name = kept(key, name, False)
            if out.num_rows:
                yield out
    if len(key):
        yield kept(key, name, True)[0]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            x, sizes = shingle_sets(batch.column(0).to_pylist(), words)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names(x, sizes)), lists], ["name", "shingles"])

    return run


def _near(part: int, whole: int):
    """Those of the pairs (a, b, n, m, x, y) of sizes n, m and sketches x, y that can be similar."""

    def close(n, m, x, y):
        size = min(len(x), len(y))
        return np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= allowed(n + m, part, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [close(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_pairs(part: int, whole: int, forest: bool, rows: int = 256):
    """Pairs of a task's documents in different classes whose sketches allow them to be similar: all of them, or with
    `forest` only as many as join the classes that they would join. `side` tells the chunks of a large bucket apart: pairs
    are made between them only, 2 is a task of one chunk."""

    def distances(bits, ok):
        """Sketch distances where `ok`, a large number elsewhere."""
        out = np.full(ok.shape, 1 << 40, np.int64)
        i, j = np.nonzero(ok)
        for cut in range(0, len(i), 1 << 14):
            p, q = i[cut : cut + (1 << 14)], j[cut : cut + (1 << 14)]
            out[p, q] = np.bitwise_count(bits[0][p] ^ bits[1][q]).sum(axis=1, dtype=np.int64)
        return out

    def chosen(apart, a, b, own, up):
        """Pairs that join classes, each row with the nearest document of another class, until none can be joined."""
        while True:
            left, right = up[own[a]], up[own[b]]
            apart[left[:, None] == right[None, :]] = 1 << 40
            best = apart.argmin(axis=1)
            hits = np.flatnonzero(apart[np.arange(len(a)), best] < 1 << 40)
            if not len(hits):
                return
            for i in hits.tolist():
                x, y = up[own[a[i]]], up[own[b[best[i]]]]
                if x != y:
                    up[up == max(x, y)] = min(x, y)
                    yield a[i], b[best[i]]

    def pairs(names_, sizes, roots, sides, raws):
        small = min(map(len, raws))
        bits = np.stack([folded(r, small) for r in raws])
        names_, sizes, sides = map(np.array, (names_, sizes, sides))
        own = np.unique(roots, return_inverse=True)[1]
        up = np.arange(own.max() + 1)
        for at in range(0, len(names_), rows):
            a = np.arange(at, min(at + rows, len(names_)))
            b = np.arange(at, len(names_))
            limit = allowed(sizes[a][:, None] + sizes[b][None, :], part, whole)
            ok = (up[own[a]][:, None] != up[own[b]][None, :]) & (a[:, None] < b[None, :]) & (np.abs(sizes[a][:, None] - sizes[b][None, :]) <= limit)
            ok &= (sides[a][:, None] != sides[b][None, :]) | (sides[a][:, None] == 2)
            apart = distances((bits[a], bits[b]), ok)
            apart[apart > limit] = 1 << 40
            found = list(chosen(apart, a, b, own, up)) if forest else list(zip(*((x[k] for x, k in zip((a, b), np.nonzero(apart < 1 << 40))))))
            if found:
                x, y = names_[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [], [], [], [])
        for batch in batches:
            for now, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != task:
                    if len(held[0]) > 1:
                        yield from pairs(*held)
                    task, held = now, ([], [], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if len(held[0]) > 1:
            yield from pairs(*held)

    return run


def _links(pairs: DataFrame, part: int, whole: int, known: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar: sketches first, then the sets of those that are left."""
    one = known.select(F.col("name").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    two = known.select(F.col("name").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")
    near = saved(near.mapInArrow(_near(part, whole), "a long, b long"), "near")
    wanted = saved(near.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(known.select("name", "least"), "name"), "wanted")
    own = texts.join(wanted.select(F.col("least").alias("__id")).distinct(), F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    # Of rows that share an id some have other sets.
    sets = own.mapInArrow(_sets(words), "name long, shingles array<long>").join(wanted.select("name"), "name", "left_semi")
    sets = saved(sets.groupBy("name").agg(F.first("shingles").alias("shingles")), "sets")
    both = near.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(whole * F.col("both") >= part * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def similar_documents(
    docs: DataFrame,
    part: int = PART,
    whole: int = WHOLE,
    words: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 2,
    chunk: int = 4_000,
) -> DataFrame:
    """`id_col`, `n_shingles`, `n_links` (distinct other sets its own was found linked to), `component_id` of every row:
    the smallest id reachable by links of similarity `part` / `whole` and more, its own included.

    Shingles are `words` words of the whole text, A-Z in lower case. Texts without words, empty and null ones are linked
    with nothing. Repeated rows and other rows of equal sets are linked. Null ids take part and stay null; a class of null
    ids only has a null `component_id`. An empty table gives no rows; other columns are ignored. Sets are told apart by
    64-bit names, and shingles by 64-bit hashes.

    Each link is exact and the classes are complete; `n_links` counts the links that connect a class, not all within it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    marked = saved(own.mapInArrow(_marked(kind, words, part, whole), f"id {kind}, name long, n long, keys array<long>, sketch binary"), "marked")
    fresh = marked.where(F.size("keys") > 0)
    dealt = fresh.select(F.explode("keys").alias("key"), "name").repartition("key").sortWithinPartitions("key", "name")
    buckets = saved(dealt.mapInArrow(_shared, "key long, name long"), "buckets")
    # What is known of the documents that share a key with another one.
    known = fresh.join(buckets.select("name").distinct(), "name", "left_semi").groupBy("name")
    known = saved(known.agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "known")
    links, open_, tested = None, buckets, []
    for _ in range(rounds):
        centres = open_.groupBy("key").agg(F.min("name").alias("a"))
        pairs = open_.join(centres, "key").where("name <> a").select("a", F.col("name").alias("b")).distinct()
        links = _more(links, pairs, tested, part, whole, known, own, words)
        classes = saved(components(links), "classes")
        rest = open_.join(centres, "key").where("name <> a").select("key", "name")
        open_ = saved(_apart(rest, classes), "open")
    # First as few pairs as join what can be joined, then, between the classes that this leaves, all.
    for forest in (True, True, False):
        if not open_.take(1):
            break
        pairs = _close(open_, classes, known, part, whole, chunk, forest).distinct()
        links = _more(links, pairs, tested, part, whole, known, own, words)
        classes = saved(components(links), "classes")
        open_ = saved(_apart(open_, classes), "open")
    ends = links.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    members = marked.where("n > 0").groupBy("name").agg(F.min("id").alias("least"))
    members = members.join(classes, F.col("name") == F.col("node"), "left").join(ends, "name", "left")
    members = members.select("name", "least", F.coalesce("root", "name").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    result = marked.select("id", "name", "n").join(members.join(named, "root").select("name", "n_links", "component_id"), "name", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))


def _more(links: DataFrame | None, pairs: DataFrame, tested: list[DataFrame], part: int, whole: int, known: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The links so far, and those among the pairs that were not tested before."""
    for done in tested:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    tested.append(saved(pairs, "pairs"))
    found = _links(tested[-1], part, whole, known, texts, words)
    return saved(found if links is None else links.unionByName(found), "links")


def _apart(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the keys whose names are not all in one class."""
    named = rows.join(classes, F.col("name") == F.col("node"), "left").select("key", "name", F.coalesce("root", "name").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(several, "key", "left_semi")


def _close(rows: DataFrame, classes: DataFrame, known: DataFrame, part: int, whole: int, chunk: int, forest: bool) -> DataFrame:
    """Pairs of a bucket in different classes whose sketches are close enough. Buckets of more than `chunk` documents are
    dealt into chunks, and each pair of chunks is a task of its own."""
    named = rows.join(classes, F.col("name") == F.col("node"), "left").select("key", "name", F.coalesce("root", "name").alias("root"))
    sized = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    dealt = named.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("name"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "name", "root", side.alias("side"))
    full = dealt.join(known.select("name", "n", "sketch"), "name").select("task", "name", "n", "root", "side", "sketch")
    return full.repartition("task").sortWithinPartitions("task").mapInArrow(_near_pairs(part, whole, forest), "a long, b long")
