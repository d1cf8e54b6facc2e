"""The parity-sketch join against all pairs."""

import random
import re

import numpy as np
import pytest

from pressgrain.llm import parity
from tests.llm.fixtures import frame, texts, words


def slow_set(text, k=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def slow_classes(rows, part=85, whole=100):
    sets = [slow_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and whole * both >= part * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows, **options):
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity.similar_documents(frame(spark, rows).repartition(4), **options).collect())))
    assert got == sorted(map(str, slow_classes(rows)))


def edited(rng, text, edits):
    own = text.split(" ")
    for _ in range(edits):
        own[rng.randrange(len(own))] = words(rng, 1)
    return " ".join(own)


def test_awkward_texts(spark):
    check(spark, [*enumerate(texts()), (None, "no id here"), (9, texts()[9]), (None, texts()[10]), (50, "A b C"), (51, "a B c"), (52, "a b")])
    assert parity.similar_documents(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"rounds": 0 + 1, "chunk": 5}), (3, {"chunk": 3})])
def test_near_copies_of_many_sizes(spark, seed, options):
    rng = random.Random(seed)
    rows = []
    for size in (4, 6, 9, 12, 20, 35, 60, 110, 300, 900):
        base = words(rng, size, "abcdefghijklmnop")
        for _ in range(9):
            rows.append((len(rows), edited(rng, base, rng.choice([0, 1, 1, 2, max(1, size // 60), max(1, size // 35), max(1, size // 25)]))))
        own = base.split(" ")
        rows += [(len(rows), " ".join(own[: max(1, int(size * f))])) for f in (0.86, 0.9)]
    passage = words(rng, 60)
    rows += [(len(rows) + i, passage + " " + words(rng, rng.choice([4, 8, 12, 20, 40]))) for i in range(60)]
    check(spark, rows, **options)


def test_limits_of_similarity_share_a_key():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.choice([7, 8, 12, 13, 20, 39, 40, 60, 99, 100, 150, 400]))
        x = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        a, b = x[:n], x[int(rng.integers(0, n // 5 + 1)) : n + int(rng.integers(0, n // 5 + 1))]
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        got = []
        for own in (a, b):
            got.append(set(parity.keys(np.sort(own), np.array([len(own)]))[1].tolist()))
        assert got[0] & got[1]
        one, two = parity.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        small = min(len(one), len(two))
        apart = int(np.bitwise_count(parity.folded(one, small) ^ parity.folded(two, small)).sum())
        assert apart <= len(a) + len(b) - 2 * both <= parity.allowed(np.int64(len(a) + len(b)))


def test_sets_that_are_poor_in_blocks_are_found():
    """Sets chosen so that all shingles fall into few blocks under the first hash: later hashes or the empty blocks serve."""
    rng = np.random.default_rng(5)
    for seeds in (1, 3):
        for _ in range(200):
            x = np.sort(rng.integers(0, 2**60, 60, dtype=np.uint64))  # the lowest sixteenth of the range
            a, b = x, np.delete(x, rng.choice(60, 4, replace=False))
            ka, kb = (set(parity.keys(s, np.array([len(s)]), seeds=seeds)[1].tolist()) for s in (a, b))
            assert ka & kb
