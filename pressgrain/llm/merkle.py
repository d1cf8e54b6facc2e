"""A Merkle tree per group over a data set, whose parents keep the SHA-256 state in front of each of their child slots.

A child enters its parent's hash as 64 hex digits, which is one block of SHA-256. The state in front of a slot is
therefore 8 words with nothing pending: 32 bytes that can stand in a table. To fold a replaced row up to the root, the
state in front of its slot is resumed with the replacement and the siblings to its right; what lies to the left is never
hashed again. States of many rows are advanced together as numpy arrays.

The tree is built in bands of `height` levels. A task takes the `fan ** height` entries under one node of the band's top,
and only that node goes on to the next band, so the tables shrink by that factor. Paths are then handed down band by band,
one per block, and the rows of a block are proved and folded with their block's path. A hot group is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import saved
from pressgrain.llm.ranks import ranked

FAN, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
#: SHA-256 takes the first 32 bits behind the point of cube roots and square roots of primes.
ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)[:, None]
#: Four hex digits of every 16-bit number, as one big-endian word.
DIGITS = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def advanced(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after one more block (16, n) each."""
    a, b, c, d, e, f, g, h = state
    w = list(block)
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + w[t - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def child_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as blocks (16, n) of hex digits."""
    block = np.empty((16, digests.shape[1]), np.uint32)
    block[0::2], block[1::2] = DIGITS[digests >> np.uint32(16)], DIGITS[digests & np.uint32(0xFFFF)]
    return block


def closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of states that have taken so many children."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, children * 512
    return advanced(state, last)


def words_of(raw: Sequence[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(raw), ">u4").reshape(-1, 8).T.astype(np.uint32))


def bytes_of(words: np.ndarray) -> list[bytes]:
    raw = words.T.astype(">u4").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


@dataclass
class Level:
    """One level of a block: the children, and per parent how many it has and its states in front of each slot."""

    children: np.ndarray
    counts: np.ndarray
    states: np.ndarray  # (fan, 8, parents)

    @staticmethod
    def over(children: np.ndarray, fan: int) -> Level:
        m = children.shape[1]
        counts = np.minimum(fan, m - fan * np.arange(-(-m // fan)))
        states = np.zeros((fan, 8, len(counts)), np.uint32)
        states[0] = START
        for slot in range(1, fan):
            full = counts > slot - 1
            states[slot] = states[slot - 1]
            states[slot][:, full] = advanced(states[slot - 1][:, full], child_block(children[:, np.flatnonzero(full) * fan + slot - 1]))
        return Level(children, counts, states)

    def parents(self) -> np.ndarray:
        """Digests of all parents, resumed in front of their last child."""
        fan, at = len(self.states), np.arange(len(self.counts))
        last = self.counts - 1
        state = np.stack([self.states[s][:, i] for i, s in zip(at, last)], axis=1)
        return closed(advanced(state, child_block(self.children[:, at * fan + last])), self.counts)

    def fold(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Digests of the parents of the children `at`, if these had `values`."""
        fan = len(self.states)
        parent, slot = at // fan, at % fan
        state = advanced(self.states[slot, :, parent].T, child_block(values))
        for right in range(1, fan):
            more = slot + right < self.counts[parent]
            state[:, more] = advanced(state[:, more], child_block(self.children[:, at[more] + right]))
        return closed(state, self.counts[parent])


def _place_on_path(step: dict, values: np.ndarray) -> np.ndarray:
    """One level of a path: resume the state with the values and the right siblings."""
    rights = [step["right"][i : i + 32] for i in range(0, len(step["right"]), 32)]
    wide = lambda raw: np.repeat(words_of([raw]), values.shape[1], axis=1)
    state = advanced(wide(step["state"]), child_block(values))
    for raw in rights:
        state = advanced(state, child_block(wide(raw)))
    return closed(state, 1 + (len(step["left"]) + len(step["right"])) // 32)


def _band(fan: int, height: int, base: int):
    """All parents of a block over up to `height` levels; the last has `top` set."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        n, place = block["n"][0].as_py(), block["place"][0].as_py()
        now, out = words_of(block["digest"].to_pylist()), []
        for step in range(1, height + 1):
            if n == 1:
                break
            level = Level.over(now, fan)
            now, n, place = level.parents(), -(-n // fan), place // fan
            out.append((level, now, n, place, base + step))
        key, home = block["key"][0].as_py(), block["block"][0].as_py()
        made = []
        for k, (level, digests, left, first, depth) in enumerate(out):
            m = digests.shape[1]
            states = [bytes_of(s) for s in level.states]
            made.append(
                pa.table(
                    {
                        "key": [key] * m, "block": [home] * m, "level": pa.array([depth] * m, pa.int32()), "place": range(first, first + m), "n": [left] * m,
                        "digest": pa.array(bytes_of(digests), pa.binary()), "children": pa.array(level.counts.astype(np.int32)),
                        "states": pa.array([list(x) for x in zip(*states)], pa.list_(pa.binary())), "top": [k == len(out) - 1] * m,
                    }
                )
            )
        return pa.concat_tables(made)

    return run


NODE = "key string, block long, level int, place long, n long, digest binary, children int, states array<binary>, top boolean"
PATH = "path array<struct<left binary, state binary, right binary>>, subroot binary, root binary"
STEP = pa.list_(pa.struct([("left", pa.binary()), ("state", pa.binary()), ("right", pa.binary())]))


def _unpacked(left: pa.Table, right: pa.Table) -> tuple[pa.Table, list[Level], dict]:
    """Entries of a block in order, its levels as they stand in the table of nodes, and the row of its path."""
    left, rows = left.sort_by("place"), right.sort_by([("level", "ascending"), ("place", "ascending")]).to_pylist()
    path = next(r for r in rows if r["level"] is None)
    children, levels = words_of(left["digest"].to_pylist()), []
    for depth in sorted({r["level"] for r in rows} - {None}):
        own = [r for r in rows if r["level"] == depth]
        fan = len(own[0]["states"])
        states = np.stack([words_of([r["states"][s] for r in own]) for s in range(fan)])
        levels.append(Level(children, np.array([r["children"] for r in own]), states))
        children = words_of([r["digest"] for r in own])
    return left, levels, path


def _handed_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """The path of every entry of a block to the root."""
    left, levels, top = _unpacked(left, right)
    raws = [bytes_of(level.children) for level in levels]
    paths = []
    for i in range(left.num_rows):
        steps, at = [], i
        for level, raw in zip(levels, raws):
            fan = len(level.states)
            run = range(at // fan * fan, at // fan * fan + int(level.counts[at // fan]))
            state = bytes_of(level.states[at % fan][:, at // fan][:, None])[0]
            steps.append({"left": b"".join(raw[j] for j in run if j < at), "state": state, "right": b"".join(raw[j] for j in run if j > at)})
            at //= fan
        paths.append(steps + top["path"])
    m = left.num_rows
    return pa.table({"key": left["key"], "place": left["place"], "path": pa.array(paths, STEP), "subroot": pa.array([top["subroot"]] * m, pa.binary()), "root": pa.array([top["root"]] * m, pa.binary())})


def _proved(left: pa.Table, right: pa.Table) -> pa.Table:
    """Digest of each row's siblings, and the root that its replaced digest folds to."""
    left, levels, top = _unpacked(left, right)
    names = [[x.hex().encode() for x in bytes_of(level.children)] for level in levels]
    above = b"".join((step["left"] + step["right"]).hex().encode() for step in top["path"])
    proofs = []
    for i in range(left.num_rows):
        parts, at = [], i
        for level, own in zip(levels, names):
            fan = len(level.states)
            first = at // fan * fan
            parts += own[first:at] + own[at + 1 : first + int(level.counts[at // fan])]
            at //= fan
        proofs.append(hashlib.sha256(b"".join(parts) + above).hexdigest())
    at, values = np.arange(left.num_rows), words_of(left["changed"].to_pylist())
    for level in levels:
        values = level.fold(at, values)
        at = at // len(level.states)
    # Rows that were not replaced have all folded to their block's own node: equal values go on as one.
    values, back = np.unique(values, axis=1, return_inverse=True)
    for step in top["path"]:
        values = _place_on_path(step, values)
    folded = [x.hex() for x in bytes_of(values[:, back.ravel()])]
    m, root = left.num_rows, top["root"].hex()
    return pa.table(
        {
            "id": left["id"], "leaf": pa.array([x.hex() for x in left["digest"].to_pylist()], pa.string()), "subroot": [top["subroot"].hex()] * m, "root": [root] * m,
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
        }
    )


@dataclass
class Tree:
    """`entries[b]` go into band b, whose parents are `nodes[b]`; `tops` has the last node of every key."""

    fan: int
    height: int
    entries: list[DataFrame] = field(default_factory=list)
    nodes: list[DataFrame] = field(default_factory=list)
    tops: DataFrame | None = None

    @staticmethod
    def over(entries: DataFrame, fan: int, height: int) -> Tree:
        """`entries`: key, place (gapless from 0 per key), n (entries of the key), digest."""
        tree, now, done = Tree(fan, height), entries, []
        while True:
            tree.entries.append(now)
            done.append(now.where("n = 1").select("key", "digest"))
            if not now.where("n > 1").take(1):
                break
            block = F.floor(F.col("place") / fan**height).alias("block")
            blocks = now.where("n > 1").select("key", block, "place", "n", "digest").groupBy("key", "block")
            tree.nodes.append(saved(blocks.applyInArrow(_band(fan, height, height * len(tree.nodes)), NODE), "nodes"))
            now = tree.nodes[-1].where("top").select("key", "place", "n", "digest")
        tree.tops = done[0]
        for more in done[1:]:
            tree.tops = tree.tops.unionByName(more)
        return tree

    def met(self, band: int, paths: DataFrame | None, tops: DataFrame):
        """Entries of a band next to the nodes and the path of their block."""
        block = F.when(F.col("n") > 1, F.floor(F.col("place") / self.fan**self.height)).otherwise(0).cast("long")
        left = self.entries[band].withColumn("block", block)
        alone = left.where("n = 1").select(F.col("key").alias("name"), F.col("block").alias("home"))
        above = alone.join(tops, alone["name"] == tops["key"]).select(F.col("name").alias("key"), F.col("home").alias("block"), "path", "subroot", "root")
        if paths is not None:
            above = above.unionByName(paths.withColumnRenamed("place", "block"))
        right = above
        if band < len(self.nodes):
            right = right.unionByName(self.nodes[band].select("key", "block", "level", "place", "digest", "children", "states"), allowMissingColumns=True)
        else:
            right = right.withColumns({"level": F.lit(None).cast("int"), "place": F.lit(None).cast("long")})
        return left.groupBy("key", "block").cogroup(right.groupBy("key", "block"))

    def paths(self, tops: DataFrame, last: int) -> DataFrame | None:
        """Paths of the entries of band `last`, given those of the last nodes of all keys; None if there is no such band."""
        found = None
        for band in range(len(self.entries) - 1, last - 1, -1):
            found = saved(self.met(band, found, tops).applyInArrow(_handed_down, f"key string, place long, {PATH}"), "paths")
        return found


def said(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, `:` and itself; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, fields: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 of all fields of a row, some of them possibly replaced."""
    return F.unhex(F.sha2(F.concat(*(said((changed or {}).get(c, docs[c])) for c in fields)), 256))


def manifest(
    docs: DataFrame,
    changed: Mapping[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    fan: int = FAN,
    height: int = HEIGHT,
) -> DataFrame:
    """Per row: `id_col`, `leaf`, `subroot` (of its group), `root` (of all groups), `proof_sha256` (digest of the siblings
    on its way up), `folded_root` (from the leaf with the columns `changed` replaced and the original siblings) and
    `verified` (equal to `root`).

    Rows of a group ascend by `id_col`, null ids first, rows that share an id by their leaf; equal rows are leaves of their
    own and stand next to each other in any order. Groups ascend bytewise, the null group first and apart from the empty
    one. Null fields enter as `-`, so null and empty texts differ. An empty table gives no rows. Columns that are not
    fields are ignored, whatever their names.
    """
    group = F.coalesce(F.concat(F.lit("+"), docs[group_col].cast("string")), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(group.alias("key"), docs[id_col].alias("id"), leaf(docs, fields).alias("digest"), leaf(docs, fields, changed).alias("changed"))
    leaves = saved(ranked(saved(own, "leaves"), "key", ["id", "digest"]), "leaves")
    lower = Tree.over(leaves, fan, height)
    # The groups' roots, themselves ordered by group, are the entries of the upper tree.
    groups = ranked(saved(lower.tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "subroots"), "key", ["name"])
    upper = Tree.over(saved(groups, "subroots"), fan, height)
    root = upper.tops.select("key", F.array().cast("array<struct<left:binary,state:binary,right:binary>>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    ways = upper.paths(root, 0).drop("key").join(upper.entries[0].select("place", "name", "digest"), "place")
    tops = saved(ways.select(F.col("name").alias("key"), "path", F.col("digest").alias("subroot"), "root"), "tops")
    paths = lower.paths(tops, 1)
    proofs = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return lower.met(0, paths, tops).applyInArrow(_proved, f"id {kind}, {proofs}").withColumnRenamed("id", id_col)
