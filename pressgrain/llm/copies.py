"""Near copies of whole documents: SimHash fingerprints give candidates, exact Jaccard similarity gives the links.

Texts are compared by their five-word shingles in lower case. Texts of equal words are folded first. Their fingerprints are
linked by the forest of vantage-point trees of `simhash`; every pair within its radius becomes a candidate. Similarity 0.8
lies about 10 of 64 bits apart on average, 15 and more at times, and a radius that wide would have to compare nearly all
pairs. So what lies beyond the radius is found by the MinHash bands of `paragraphs`: texts that agree in a band are
candidates too. Each text travels once, to the task of its component of candidates, and only pairs whose exact similarity
suffices become links. Large components are dealt into chunks, and each pair of chunks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import components, saved, slices
from pressgrain.llm.paragraphs import BANDS, band_keys, bucket_links, shingles, word_hashes
from pressgrain.llm.simhash import fingerprint, links

#: Words of a shingle.
SHINGLE = 5


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in slices(batches, 64):
        words = [_words(t) for t in batch.column(1).to_pylist()]
        if not words:
            continue
        texts = [" ".join(w) for w in words]
        names = [xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        keys = band_keys(*shingles(*word_hashes(texts)))
        marks = pa.array([fingerprint(t, SHINGLE) for t in texts], pa.int64())
        bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
        sizes = pa.array([len(w) for w in words], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), sizes, marks, bands], ["id", "name", "words", "fp", "bands"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in slices(batches, 64):
        texts = [" ".join(_words(t)) for t in batch.column(0).to_pylist()]
        names = [xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.string())], ["name", "text"])


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []

        def links():
            found = bucket_links(names, sets, least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, 64):
            tasks, own, texts = (c.to_pylist() for c in batch.columns)
            hashes, starts = shingles(*word_hashes(texts))
            for task, name, values in zip(tasks, own, np.split(hashes, starts[1:])):
                if task != key and len(names) > 1:
                    yield links()
                if task != key:
                    key, names, sets = task, [], []
                names.append(name), sets.append(set(values.tolist()))
        if len(names) > 1:
            yield links()

    return run


def near_copies(docs: DataFrame, similar: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 2_000, chunk_words: int = 1_000_000, radius: int = 4) -> DataFrame:
    """`id_col`, `name` (of the words in lower case), `component_id` of every row: the smallest id among the rows reachable
    by links of similarity `similar` and more.

    Texts without words (null or empty too) are copies of each other. Repeated rows stay and share a class. Null ids take
    part and stay null; a class of null ids only has a null `component_id`. Pairs whose fingerprints differ in at most
    `radius` bits are all compared; others of similarity 0.8 are missed with a chance of 0.2 %, closer ones less often.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    marked = saved(own.mapInArrow(_marked, f"id {kind}, name binary, words long, fp long, bands array<long>"), "copies")
    distinct = marked.groupBy("name").agg(F.min("id").alias("least"), F.first("words").alias("words"))
    marks = saved(marked.groupBy("fp").agg(F.min("name").alias("center")), "fingerprints")
    close = links(marks.select("fp"), radius).join(marks.select(F.col("fp").alias("a"), F.col("center").alias("own")), "a").join(marks.select(F.col("fp").alias("b"), F.col("center").alias("other")), "b")
    close = close.select(F.col("own").alias("a"), F.col("other").alias("b"))
    alike = marked.join(marks, "fp").select(F.col("name").alias("a"), F.col("center").alias("b")).where("a <> b")
    bands = marked.groupBy("name").agg(F.first("bands").alias("bands")).select("name", F.explode("bands").alias("key"))
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("center")).where("n > 1")
    banded = bands.join(met.select("key", "center"), "key").select(F.col("name").alias("a"), F.col("center").alias("b"))
    near = saved(components(close.unionByName(alike).unionByName(banded), "candidates"), "candidates")
    asked = near.join(distinct, F.col("node") == F.col("name")).select("name", "root", "words")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / chunk_rows, F.sum("words") / chunk_words)).cast("int")
    asked = asked.select("name", "root").join(asked.groupBy("root").agg(chunks.alias("chunks")), "root")
    texts = own.select("text").mapInArrow(_named, "name binary, text string").join(asked.select("name"), "name", "left_semi").groupBy("name").agg(F.min("text").alias("text"))
    part = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    dealt = asked.withColumn("own", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("name", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    pairs = texts.join(dealt, "name").select("task", "name", "text").repartition("task").sortWithinPartitions("task")
    classes = components(pairs.mapInArrow(_linked(similar), "a binary, b binary"))
    members = distinct.join(classes, F.col("name") == F.col("node"), "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    result = marked.select("id", "name").join(members.join(named, "root").select("name", "component_id"), "name")
    return result.select(F.col("id").alias(id_col), "name", "component_id")


def named(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct texts of `docs` (null too) as `__text`, and the `__name` that `near_copies` gives them."""
    rows = docs.select(docs[text_col].alias("__text")).distinct()

    def run(batches):
        for batch in batches:
            for given, found in zip(slices([batch], 64), _named([pa.RecordBatch.from_arrays([batch.column(0)], ["text"])])):
                yield pa.RecordBatch.from_arrays([given.column(0), found.column(0)], ["__text", "__name"])

    return rows.mapInArrow(run, "__text string, __name binary")
