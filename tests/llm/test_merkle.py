"""The Merkle manifest against a plain build of the tree with hashlib."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressgrain.llm import merkle
from pressgrain.llm.ranks import ranked
from tests.llm.fixtures import frame, rows_of, texts


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_up(nodes):
    """Levels of a tree over hex digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def slow_way(levels, at, value):
    siblings = []
    for level in levels[:-1]:
        first = at // 3 * 3
        run = level[first : first + 3]
        siblings += [x for j, x in enumerate(run) if first + j != at]
        value = sha(*(value if first + j == at else x for j, x in enumerate(run)))
        at //= 3
    return siblings, value


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
    trees = {g: slow_up([slow_leaf(r) for r in groups[g]]) for g in groups}
    top = slow_up([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            new = slow_leaf((*r[:4], r[4].replace("\n", ""))) if tampered else slow_leaf(r)
            below, value = slow_way(trees[g], i, new)
            above, value = slow_way(top, k, value)
            out.append((r[0], slow_leaf(r), trees[g][-1][0], top[-1][0], sha(*below, *above), value, value == top[-1][0]))
    return out


def tampering():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))}


def result(df):
    return sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(1)
    raw = [rng.bytes(32) for _ in range(50)]
    for n in (1, 2, 3):
        state = np.repeat(merkle.START, 50, axis=1)
        for _ in range(n):
            state = merkle.advanced(state, merkle.child_block(merkle.words_of(raw)))
        want = [hashlib.sha256(x.hex().encode() * n).digest() for x in raw]
        assert merkle.bytes_of(merkle.closed(state, np.full(50, n))) == want


@pytest.mark.parametrize("height,sources", [(1, ["a", "", None, "Z", "é", "ab"]), (2, ["hot"] * 9 + ["b", None]), (7, ["a", "b"])])
def test_manifest_equals_plain_tree(spark, height, sources):
    rows = [(i, sources[i % len(sources)], "en", len(t or ""), t) for i, t in enumerate([*texts(), *texts(2), *texts(3)])]
    rows += [(None, "a", None, None, "no id\nhere"), rows[9], rows[9], (rows[9][0], rows[9][1], "de", 1, "other\ntext")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = merkle.manifest(df, tampering(), height=height)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_manifest(rows), key=key)


def test_single_and_empty_tables_and_clashing_columns(spark):
    df = frame(spark)
    assert merkle.manifest(df.limit(0), tampering()).count() == 0
    one = merkle.manifest(frame(spark, [(4, "a\nb")]), tampering()).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof_sha256"] == sha()
    clash = df.withColumns({c: F.lit(1) for c in ("key", "digest", "place", "block", "leaf", "root", "changed", "level", "path")})
    plain = rows_of(df.select("doc_id", "source", "lang", "n_chars", "text")).values.tolist()
    want = slow_manifest([tuple(None if x is None else int(x) if i in (0, 3) else x for i, x in enumerate(r)) for r in plain])
    assert sorted(map(repr, map(tuple, merkle.manifest(clash, tampering()).collect()))) == sorted(map(repr, want))


def test_places_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1000) for i in range(3000)]
    found = ranked(spark.createDataFrame(rows, "g string, v int").repartition(6), "g", ["v"]).collect()
    own = {}
    for r in found:
        own.setdefault(r["g"], []).append((r["place"], r["v"], r["n"]))
    for g, seen in own.items():
        seen.sort()
        assert [p for p, _, _ in seen] == list(range(len(seen))) and {n for _, _, n in seen} == {len(seen)}
        assert [v for _, v, _ in seen] == sorted(v for k, v in rows if k == g)
