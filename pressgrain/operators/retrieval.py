"""Top-k retrieval of catalogue entries for texts, by an inverted index with upper bounds.

An entry scores five points for each distinct word that it shares with a text (eight words at most), sixty if its label
stands in the text, and its preference. The catalogue is cut into shards of a bounded number of words. A shard is indexed
once: entries in order of position, chunks of entries, and in each chunk a posting list per word. Texts stream past the
shards one after the other without a shuffle and carry only their best k entries.

In a chunk no entry gains more than its words' posting lists allow: five points per list that is not empty, forty at most.
A chunk whose bound does not beat the k-th best score so far is skipped without being read. Entries with more than shared
words, those whose label occurs and the preferred ones, are few; they are looked up and scored on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.operators.dedup import written

#: Rows that Spark hands to Python at once. Its own 10,000 rows of whole texts are held several times over in a task.
BATCH_ROWS = "500"

POINTS, MOST_WORDS, LABEL_POINTS, LABEL_CHARS = 5, 8, 60, 6  # fixed values of the score
PREFERRED_MOST, PREFERRED_LEAST = 40, 20
BEST = "array<struct<score:int,position:long,offering_id:{kind}>>"


class Shard:
    """Index of some entries: (id, position, label, words), best position first."""

    def __init__(self, entries: Sequence[tuple], chunk: int):
        entries = sorted(entries, key=lambda e: (e[1], e[0]))
        self.ids, self.positions = [e[0] for e in entries], [e[1] for e in entries]
        self.place = {e[0]: i for i, e in enumerate(entries)}
        self.labels: dict[str, list[int]] = {}
        for i, e in enumerate(entries):
            if e[2] and len(e[2]) >= LABEL_CHARS:
                self.labels.setdefault(e[2], []).append(i)
        self.words: dict[str, int] = {}
        sizes = np.array([len(e[3]) for e in entries], np.int64)
        flat = np.fromiter((self.words.setdefault(w, len(self.words)) for e in entries for w in e[3]), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(entries)), sizes)
        self.flat, self.ends = flat.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
        self.chunk, self.chunks = chunk, []
        for at in range(0, len(entries), chunk):
            own = slice(self.ends[at], self.ends[min(at + chunk, len(entries))])
            order = np.argsort(flat[own], kind="stable")
            starts = np.searchsorted(flat[own][order], np.arange(len(self.words) + 1)).astype(np.int32)
            self.chunks.append((starts, (owner[own][order] - at).astype(np.int32)))
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def named(self, text: str) -> set[int]:
        """Entries whose label stands in the text."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for label, places in self.labels.items():
                self._automaton.add_word(label, places)
            if self.labels:
                self._automaton.make_automaton()
        return {i for _, places in self._automaton.iter(text) for i in places} if self.labels else set()

    def best(self, text: str, wanted: Sequence, k: int, least: int, floor: int) -> list[tuple]:
        """The best `k` entries of at least `least` points as (score, position, id); entries below `floor` may be left out."""
        known = np.array([self.words[w] for w in set(text.split(" ")) if w in self.words], np.int64)
        extra = {i: LABEL_POINTS for i in self.named(text)}
        for name, rank in {name: rank for rank, name in enumerate(wanted)}.items():  # a later mention counts
            if name in self.place:
                i = self.place[name]
                extra[i] = extra.get(i, 0) + max(PREFERRED_LEAST, PREFERRED_MOST - rank)
        found = []  # (-score, place)
        if extra:
            mask = np.zeros(len(self.words) + 1, bool)
            mask[known] = True
            for i, points in extra.items():
                shared = int(mask[self.flat[self.ends[i] : self.ends[i + 1]]].sum())
                found.append((-(points + POINTS * min(MOST_WORDS, shared)), i))
            found = sorted(f for f in found if -f[0] >= least)[:k]
        for c, (starts, postings) in enumerate(self.chunks):
            lists = starts[known + 1] - starts[known]
            bound = POINTS * min(MOST_WORDS, int((lists > 0).sum()))
            # Entries of a chunk come after all found before, so an equal score does not beat the last of k.
            if bound < max(least, floor) or len(found) == k and bound < -found[-1][0]:
                continue
            first = c * self.chunk
            if len(found) == k and bound == -found[-1][0] and found[-1][1] < first:
                continue
            at = np.arange(lists.sum()) + np.repeat(starts[known] - (np.cumsum(lists) - lists), lists)
            score = POINTS * np.minimum(MOST_WORDS, np.bincount(postings[at], minlength=self.chunk))
            for i in extra:
                if first <= i < first + self.chunk:
                    score[i - first] = 0
            enough = max(least, -found[-1][0] if len(found) == k else 0, 1)
            hits = np.flatnonzero(score >= enough)
            hits = hits[np.argsort(-score[hits], kind="stable")][:k]
            found = sorted(found + [(-int(score[i]), first + int(i)) for i in hits])[:k]
        return [(-s, self.positions[i], self.ids[i]) for s, i in found]


def shards(catalogue: DataFrame, shard_words: int, chunk: int) -> Iterator[Shard]:
    """The catalogue (offering_id, position, label, words) in shards of about `shard_words` words, one at a time."""
    stored = written(catalogue, "catalogue")
    total = stored.agg(F.coalesce(F.sum(F.size("words") + 4), F.lit(0))).first()[0]
    count = max(1, -(-total // shard_words))
    part = F.pmod(F.xxhash64("offering_id"), F.lit(count))
    for i in range(count):
        yield Shard([tuple(r) for r in stored.where(part == i).select("offering_id", "position", "label", "words").collect()], chunk)


def top_entries(texts: DataFrame, catalogue: DataFrame, k: int, least: int, shard_words: int = 2_000_000, chunk: int = 2_048) -> DataFrame:
    """`doc_id`, `rank`, `offering_id`, `score` of the best `k` entries of each text.

    `texts` has doc_id, n (normalised text) and wanted (ids in order of preference); `catalogue` has offering_id, position,
    label (normalised) and words (distinct ones). Equal scores go by position, then by id. Null ids and positions of
    entries are not allowed. A shard is the only thing that is sent to all tasks, and `shard_words` bounds it.
    """
    spark, kind = texts.sparkSession, catalogue.schema["offering_id"].dataType.simpleString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    key = texts.schema["doc_id"].dataType.simpleString()
    held = BEST.format(kind=kind)
    schema = f"doc_id {key}, n string, wanted array<{kind}>, best {held}"
    rows = texts.select("doc_id", "n", "wanted", F.array().cast(held).alias("best"))
    for shard in shards(catalogue.withColumn("position", F.col("position").cast("long")), shard_words, chunk):
        if shard.ids:
            rows = rows.mapInPandas(_past(spark.sparkContext.broadcast(shard), k, least), schema)
    best = rows.select("doc_id", F.posexplode("best").alias("at", "hit"))
    return best.select("doc_id", (F.col("at") + 1).alias("rank"), "hit.offering_id", "hit.score")


def _past(shard, k: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shard.value
        for batch in batches:
            merged = []
            for text, wanted, before in zip(batch["n"], batch["wanted"], batch["best"]):
                before = [(b["score"], b["position"], b["offering_id"]) for b in before]
                floor = before[-1][0] if len(before) == k else 0
                found = before + index.best(text or "", [] if wanted is None else list(wanted), k, least, floor)
                found = sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:k]
                merged.append([{"score": s, "position": p, "offering_id": i} for s, p, i in found])
            yield batch.assign(best=merged)

    return run


def long_words(text: Column, least: int = 5) -> Column:
    """Distinct words of normalised text that have so many letters and more."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= least))
