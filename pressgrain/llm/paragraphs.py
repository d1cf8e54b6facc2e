"""Removal of repeated paragraphs by MinHash banding, exact verification and components.

A paragraph is a line with at least `least` words. Its five-word shingles give 4 minima per band; paragraphs that agree in
all minima of a band meet in a bucket. Twelve bands find a pair of similarity 0.8 with a chance of 99.8 % and closer ones
more surely. Equal paragraphs are folded first, so a passage that very many documents share is one row of a bucket. In a
bucket exact Jaccard similarities are computed until its classes are known; only a spanning forest of the links leaves it.
Buckets above `bucket_rows` are dealt into chunks, and each pair of chunks is a task of its own. Of every component one
paragraph stays, that of the smallest document id and line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import components, saved, slices

BANDS, MINIMA, SHINGLE = 12, 4, 5
_DRAW = np.random.default_rng(3)
FACTORS = _DRAW.integers(1, 2**63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _DRAW.integers(1, 2**63, BANDS * MINIMA, dtype=np.uint64)
PLACES = _DRAW.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Numbers of the characters, 0 for those at which `str.split` cuts, and odd ones of the places in a word.
_CHARS = _DRAW.integers(1, 2**64, 0x110000, dtype=np.uint64)
_CHARS[[c for c in range(0x3001) if chr(c).isspace()]] = 0
_AT = _DRAW.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all paragraphs, given their word hashes in one flat array; where each one's begin. Fewer
    words than a shingle has make one shingle of them all."""
    ends = np.cumsum(sizes)
    room = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    many = np.maximum(sizes - SHINGLE + 1, 1)
    starts = np.cumsum(many) - many
    at = np.arange(many.sum()) + np.repeat(ends - sizes - starts, many)
    left = np.repeat(np.minimum(sizes, SHINGLE), many)
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < left, room[at + k], np.uint64(0)) * PLACES[k]
    return _mix(total), starts


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys; equal keys of a band mean equal minima."""
    keys = np.zeros((len(starts), BANDS), np.uint64)
    own, shifted = np.empty_like(hashes), np.empty_like(hashes)  # filled anew for each minimum, so that no memory is asked for
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * MINIMA, (band + 1) * MINIMA):
            np.multiply(hashes, FACTORS[k], out=own)
            own += ADDENDS[k]
            np.right_shift(own, np.uint64(31), out=shifted)
            own ^= shifted
            own *= np.uint64(0x9E3779B97F4A7C15)
            key = _mix(key ^ np.minimum.reduceat(own, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words that `str.split` finds in all texts, in one flat array, and how many words each text has.

    A word is the sum of its characters' numbers, each times the number of its place in the word.
    """
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    values = _CHARS[points]
    word = values != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), sizes
    values = values[starts[0] :]
    at = np.arange(starts[0], len(points)) - np.repeat(starts, np.diff(starts, append=len(points)))
    values *= _AT[at % len(_AT)] + np.uint64(2) * (at // len(_AT)).astype(np.uint64) if at.max() >= len(_AT) else _AT[at]
    return _mix(np.add.reduceat(values, starts - starts[0])), sizes


def _hashes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([" ".join(own) for own in words])


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def bucket_links(names: list[bytes], sets: list[set], least: float) -> list[tuple[bytes, bytes]]:
    """Links that connect what all pairs of similarity `least` and more connect: one after another, each member found takes
    over those similar to it that no class has yet."""
    links, waiting = [], list(range(len(names)))
    while waiting:
        queue = [waiting.pop()]
        while queue and waiting:
            x = queue.pop()
            near, rest = [], []
            for y in waiting:
                small, large = sorted((len(sets[x]), len(sets[y])))
                (near if small >= least * large and similarity(sets[x], sets[y]) >= least else rest).append(y)
            links += [(names[x], names[y]) for y in near]
            queue += near
            waiting = rest
    return links


def _listed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, 512):
            owner, line, name, words, many = [], [], [], [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                before = len(owner)
                for k, paragraph in enumerate(text.split("\n")):
                    own = paragraph.split()
                    if len(own) >= least:
                        joined = " ".join(own)
                        owner.append(row), line.append(k), name.append(xxh3_128_digest(joined.encode("utf-8", "surrogatepass"))), words.append(joined)
                many += [len(owner) - before] * (len(owner) - before)
            if not owner:
                continue
            keys = band_keys(*shingles(*word_hashes(words)))
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            ids, k1, k2 = (batch.column(k).take(pa.array(owner)) for k in range(3))
            yield pa.RecordBatch.from_arrays([ids, k1, k2, pa.array(line, pa.int32()), pa.array(many, pa.int32()), pa.array(name, pa.binary()), bands], ["id", "k1", "k2", "line", "many", "name", "bands"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paragraphs asked for: `name`, `text`."""
    for batch in slices(batches, 512):
        names, texts = [], []
        for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for x in asked:
                names.append(x["name"]), texts.append(lines[x["line"]])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.string())], ["name", "text"])


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, texts = None, [], []

        def links():
            hashes, starts = shingles(*word_hashes(texts))
            found = bucket_links(names, [set(x.tolist()) for x in np.split(hashes, starts[1:])], least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for own, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key and len(names) > 1:
                    yield links()
                if own != key:
                    key, names, texts = own, [], []
                names.append(name), texts.append(text)
        if len(names) > 1:
            yield links()

    return run


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int").alias("k2")]


def distinct_buckets(bands: DataFrame, bucket_rows: int) -> DataFrame:
    """`key`, `name`, `chunks` of the buckets of two names or more. Close copies meet in most bands: of buckets that hold
    the same names, told by their number and a 128-bit sum of their hashes, one is looked at."""
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "name")).alias(f"sum{k}") for k in (1, 2)]
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    met = met.groupBy("n", "sum1", "sum2").agg(F.min("key").alias("key"))
    return bands.join(met.select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("chunks")), "key")


def remove_repeats(docs: DataFrame, least_words: int = 20, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 5_000) -> DataFrame:
    """All columns of `docs`, the text without its repeated paragraphs, plus `n_paragraphs`, `n_removed`, `removed` (line
    numbers from 0) and `kept_in` (the ids of the documents in which the removed ones stay).

    Lines of fewer than `least_words` words are never removed. Null texts stay null. Rows of the same id and text are one
    document. Null ids sort after all others and are not named in `kept_in`. Columns of the names added are replaced. An empty table stays empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].alias("id"), *_keys(text), text.alias("text"))
    listed = saved(own.mapInArrow(_listed(least_words), f"id {kind}, k1 long, k2 int, line int, many int, name binary, bands array<long>"), "paragraphs")
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "k1", "k2", "line")
    distinct = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    bands = listed.groupBy("name").agg(F.first("bands").alias("bands")).select("name", F.explode("bands").alias("key"))
    buckets = saved(distinct_buckets(bands, bucket_rows), "buckets")
    asked = distinct.join(buckets.select("name").distinct(), "name").select("name", "at.*")
    asked = asked.groupBy("k1", "k2").agg(F.collect_set(F.struct("name", "line")).alias("asked"))
    texts = own.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(_texts, "name binary, text string")
    texts = texts.groupBy("name").agg(F.min("text").alias("text"))
    part = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    dealt = buckets.withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("key", F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))))
    pairs = dealt.select("key", "name").join(texts, "name").select("key", "name", "text").repartition("key").sortWithinPartitions("key")
    classes = components(pairs.mapInArrow(_linked(similar), "a binary, b binary"))
    known = distinct.join(classes, F.col("name") == F.col("node"), "left").select("name", "n", "at", F.coalesce("root", "name").alias("root"))
    stays = known.groupBy("root").agg(F.sum("n").alias("n"), F.min("at").alias("stay")).where("n > 1")
    repeated = known.join(stays.select("root", "stay"), "root").select("name", "stay")
    gone = listed.join(repeated, "name").where(~place.eqNullSafe(F.col("stay")))
    per_doc = listed.groupBy("id", "k1", "k2").agg(F.max("many").cast("long").alias("n_paragraphs"))  # repeated rows have the same lines
    lost = gone.groupBy("id", "k1", "k2").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.sort_array(F.collect_set("stay.id")).alias("kept_in"))
    added = ("n_paragraphs", "n_removed", "removed", "kept_in")
    rest = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), docs[id_col].alias("id"), *_keys(text))
    facts = per_doc.join(lost, [per_doc[c].eqNullSafe(lost[c]) for c in ("id", "k1", "k2")], "left").select(per_doc["id"].alias("i"), per_doc["k1"].alias("j1"), per_doc["k2"].alias("j2"), "n_paragraphs", "removed", "kept_in")
    joined = rows.join(facts, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & F.col("id").eqNullSafe(F.col("i")), "left")
    before = F.col("row")[text_col].cast("string")
    kept = F.array_join(F.filter(F.split(before, "\n"), lambda _, k: ~F.array_contains("removed", k)), "\n")
    cleaned = F.when(F.col("removed").isNull() | before.isNull(), before).otherwise(kept)
    columns = [cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest]
    none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    return joined.select(
        *columns, F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        none("removed", "array<int>"), none("kept_in", f"array<{kind}>"),
    )
