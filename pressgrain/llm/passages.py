"""Removal of repeated word runs, wherever lines begin and end.

Every run of `least` words that stands more than once, in one text or in two, is found: its hashes of `GRAM` words have a
least one, which depends on the run alone, so equal runs share it (winnowing). Least ones that occur at two places mark the
regions in which all windows of `least` words are compared by 128-bit hashes. All places but the first are cut, their
blanks stay. Longer runs are unions of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressgrain.llm.common import saved, settled, slices
from pressgrain.llm.paragraphs import _keys, _mix, remove_repeats, word_hashes

GRAM, WORD_BITS = 16, 28  # a place is one number: the document's, then the word's
_STEPS = [(1 << k, p) for k, p in enumerate(np.random.default_rng(5).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]


def _grams(own: np.ndarray) -> np.ndarray:
    """Hashes of all runs of `GRAM` words, from the hashes of the words: runs of 2, 4, 8 and 16 words from half as long ones."""
    for step, factor in _STEPS:
        own = own[:-step] * factor + own[step:]
    return _mix(own)


def _over(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of every `width` neighbours, by doubling the width."""
    have = 1
    while 2 * have <= width:
        values, have = choose(values[:-have], values[have:]), 2 * have
    return choose(values[: len(values) - (width - have)], values[width - have :])


def _anchors(least: int):
    reach = least - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            own, sizes = word_hashes(batch.column(3).to_pylist())
            if len(own) < least:
                continue
            row, grams = np.repeat(np.arange(len(sizes)), sizes), _grams(own)
            low = _over(np.minimum, grams, reach)
            inside = np.arange(least, len(own) + 1) <= np.cumsum(sizes)[row[: len(low)]]  # windows that end in their text
            pad = np.zeros(reach - 1, np.uint64)  # of the windows around a gram none has a larger least one than the gram
            high = _over(np.maximum, np.concatenate([pad, np.where(inside, low, np.uint64(0)), pad]), reach)
            at = np.flatnonzero((high == grams) & (high > 0))
            owner, value = row[at], grams[at]
            sort = np.lexsort((value, owner))
            owner, value = owner[sort], value[sort]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])[: len(at)])
            times = np.minimum(np.diff(np.append(new, len(at))), 2)
            ids, k1, k2 = (batch.column(k).take(pa.array(owner[new])) for k in range(3))
            yield pa.RecordBatch.from_arrays([ids, k1, k2, pa.array(value[new].view(np.int64)), pa.array(times, pa.int32())], ["id", "k1", "k2", "gram", "times"])

    return run


def _windows(least: int):
    reach = least - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in slices(batches, 32):
            place, name = [], []
            docs, texts, marks = (c.to_pylist() for c in batch.columns)
            flat, sizes = word_hashes(texts)
            for doc, text, asked, own in zip(docs, texts, marks, np.split(flat, np.cumsum(sizes)[:-1])):
                words = text.split()
                hit = np.isin(_grams(own), np.array(asked, np.int64).view(np.uint64))
                before = np.concatenate([[0], np.cumsum(hit)])
                for k in np.flatnonzero(before[reach:] > before[:-reach]).tolist():
                    place.append(doc << WORD_BITS | k), name.append(xxh3_128_digest(" ".join(words[k : k + least]).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(name, pa.binary())], ["place", "name"])

    return run


def without_words(text: str, starts: list[int], least: int) -> tuple[str, int]:
    """The text without the words of the windows that begin at the word numbers `starts`, and how many words went."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out, last, gone, end = [], 0, 0, 0
    for k in sorted(starts):
        first = max(k, end)
        if first < k + least:
            out.append(text[last : spans[first][0]])
            gone, end = gone + k + least - first, k + least
            last = spans[end - 1][1]
    return "".join([*out, text[last:]]), gone


def _cut(least: int):
    @F.pandas_udf("left string, n long")
    def run(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        cut = [(None, 0) if s is None else without_words(t, s.tolist(), least) for t, s in zip(texts, starts)]
        return pd.DataFrame(cut, columns=["left", "n"])

    return run


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """Numbers without the gaps between tasks, which would leave no bits for the words: task numbers come first in
    `monotonically_increasing_id`, so each task's first number is moved behind the rows of the tasks before it."""
    stored = saved(sorted_rows, "sorted")
    part = F.shiftright("doc", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row per task
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    moved = stored.join(counts, part == F.col("part"))
    return moved.withColumn("doc", F.col("base") + F.col("doc").bitwiseAND((1 << 33) - 1)).drop("part", "base")


def remove_passages(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text without every run of `least` words that stands earlier too, plus `n_words_removed`.

    Words are compared as they are, the blanks between them do not matter. The earliest place is that of the smallest id
    (nulls last) and word number. Rows of the same id and text are one document. Null texts stay null. All runs are judged
    on the input: where two passages go, what stood around them may form a new run. An empty table stays empty; a column
    `n_words_removed` is replaced, other names never clash.
    """
    if least < GRAM:
        raise ValueError("runs must have a gram's words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].alias("id"), *_keys(text), text.alias("text"))
    keys = f"id {kind}, k1 long, k2 int"
    spark = docs.sparkSession

    def marked() -> DataFrame:
        """Documents that hold marks which occur twice, numbered in their order, so that the smallest place is the earliest."""
        anchors = saved(own.mapInArrow(_anchors(least), f"{keys}, gram long, times int"), "anchors")
        twice = anchors.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram")
        asked = anchors.join(twice, "gram").groupBy("id", "k1", "k2").agg(F.collect_set("gram").alias("asked"))
        ordered = asked.orderBy(F.col("id").asc_nulls_last(), "k1", "k2").withColumn("doc", F.monotonically_increasing_id())
        return _numbered(ordered.select(F.col("id").alias("i"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), "doc", "asked"))

    ordered = settled(spark, "numbered", marked)
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))
    regions = lambda: own.join(ordered, same).select("doc", "text", "asked")
    windows = settled(spark, "windows", lambda: regions().mapInArrow(_windows(least), "place long, name binary"))
    first = windows.groupBy("name").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("name", "first")
    gone = windows.join(first, "name").where("place <> first")
    starts = gone.groupBy(F.shiftright("place", WORD_BITS).alias("doc")).agg(F.collect_set(F.col("place").bitwiseAND((1 << WORD_BITS) - 1).cast("int")).alias("starts"))
    starts = starts.join(ordered.select("doc", "i", "j1", "j2"), "doc").select("i", "j1", "j2", "starts")
    rest = [c for c in docs.columns if c != "n_words_removed"]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), docs[id_col].alias("id"), *_keys(text))
    joined = rows.join(starts, same, "left")
    # Only texts that lose something go to Python.
    touched = F.when(F.col("starts").isNotNull(), F.col("row")[text_col].cast("string"))
    joined = joined.withColumn("cut", _cut(least)(touched, F.col("starts")))
    columns = [F.when(F.col("starts").isNotNull(), F.col("cut.left")).otherwise(F.col("row")[c].cast("string")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in rest]
    return joined.select(*columns, F.coalesce("cut.n", F.lit(0).cast("long")).alias("n_words_removed"))


def remove_repeated_text(docs: DataFrame, least_words: int = 20, similar: float = 0.8, least_run: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the paragraphs that `remove_repeats` keeps elsewhere, near copies included, and without the runs of
    `least_run` words that then still stand earlier: inside longer lines, or wrapped over short ones.

    Adds `n_paragraphs`, `n_removed`, `removed` and `kept_in` of the paragraphs and `n_words_removed` of the runs; columns
    of these names are replaced. Nulls, repeated rows and empty tables are treated as in the two steps. What the first has
    written is let go before the second begins.
    """
    found = settled(docs.sparkSession, "paragraphs", lambda: remove_repeats(docs, least_words, similar, id_col, text_col))
    return remove_passages(found, least_run, id_col, text_col)
