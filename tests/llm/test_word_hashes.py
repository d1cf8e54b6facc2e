"""Hashes of words taken from whole texts, and buckets that hold the same names."""

import random

from pyspark.sql import functions as F

from pressgrain.llm import paragraphs


def test_word_hashes_cut_like_split():
    draw = random.Random(1)
    signs = [chr(c) for c in range(0x3005) if chr(c).isspace()] + [*"abcdé", "\U0001f600", "\ud800", "\x00", "​"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(2000)] + ["", " ", "x" * 9000 + " " + "x" * 9001, " a "]
    found, sizes = paragraphs.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(found) == len(words)
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(words, found.tolist()))
    assert len(set(known.values())) == len(known)
    assert [len(x) for x in paragraphs.word_hashes([""])] == [0, 1] and [len(x) for x in paragraphs.word_hashes([])] == [0, 0]


def test_buckets_of_the_same_names_are_looked_at_once(spark):
    held = {1: "ab", 2: "ab", 3: "abc", 4: "a", 5: "bc", 6: "abc"}
    bands = spark.createDataFrame([(n.encode(), k) for k, names in held.items() for n in names], "name binary, key long")
    found = paragraphs.distinct_buckets(bands, 2).groupBy("key").agg(F.array_sort(F.collect_list("name")).alias("names"), F.max("chunks").alias("chunks"))
    assert sorted((r["key"], b"".join(r["names"]), r["chunks"]) for r in found.collect()) == [(1, b"ab", 1), (3, b"abc", 2), (5, b"bc", 1)]
