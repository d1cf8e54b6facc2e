"""The conversation trie and the contraction against plain versions."""

import hashlib
import random
import re
import zlib

import pytest

from pressgrain.llm import trie


def slow_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def slow_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, spared = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        spared[node] = (len(members[node]) - 1) * words + sum(spared[k] for k in below)
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids.get(node, [])), leaves[node], spared[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string" + extra).repartition(5)
    return trie.prefix_trie(*trie.rebuilt(trie.placed_turns(df)))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 150):
        deep = 60 if c == 7 else rng.choice([1, 1, 2, 3, 4, 8])
        for t in range(deep):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi there", "tell me  more", "", "a\tb\nc"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 8)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = conversations(seed)
    rows += [(500, None, None, None), (500, 3, "user", "x"), (500, 3, "user", "x"), (500, 3, "assistant", "y"), (None, 1, "user", "none"), (501, 0, "", ""), (502, 0, None, "word " * 5000)]
    got = sorted(map(str, map(tuple, run(spark, rows).collect())))
    assert got == sorted(map(str, slow_trie(slow_rebuilt(rows))))


def test_copies_turnless_and_empty_tables(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(80, 100) for t in range(5)]  # they begin like 80, and are all the same
    assert sorted(map(str, map(tuple, run(spark, same).collect()))) == sorted(map(str, slow_trie(slow_rebuilt(same))))
    alone = [c for c in range(1, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    turnless = [(c, t, "user", "gone") for c in alone for t in range(2)]
    found = run(spark, [(*r, 1, "x") for r in turnless], ", place long, node string").collect()
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in found] == [(0, 3, 1)]
    assert found[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    assert run(spark, []).count() == 0


def shapes():
    rng = random.Random(4)
    chain = [(i, i - 1 if i else None) for i in range(70)]
    star = [(0, None)] + [(i, 0) for i in range(1, 60)]
    broom = chain[:40] + [(100 + i, 39) for i in range(9)] + [(200 + i, 100 + i) for i in range(9)]
    binary = [(i, (i - 1) // 2 if i else None) for i in range(127)]
    grown = [(0, None)] + [(i, rng.randrange(max(0, i - 4), i)) for i in range(1, 200)]
    forest = [(i, None if i % 50 == 0 else i - 1 - rng.randrange(min(3, i % 50))) for i in range(150)]
    return {"chain": chain, "star": star, "broom": broom, "binary": binary, "grown": grown, "forest": forest, "one": [(5, None)], "lost parent": [(1, 9), (2, 1)], "none": []}


@pytest.mark.parametrize("name", shapes())
def test_contraction_equals_plain_sums(spark, name):
    edges = shapes()[name]
    rng = random.Random(2)
    value = {i: rng.randrange(100) for i, _ in edges}
    want = dict(value)
    up = dict(edges)
    for i, parent in edges:
        while parent in value:
            want[parent] += value[i]
            parent = up[parent]
    df = spark.createDataFrame([(i, p, value[i], 1) for i, p in edges], "id long, parent long, v long, one long")
    assert {r["id"]: r["v"] for r in trie.subtree_totals(df, ["v", "one"]).collect()} == want
