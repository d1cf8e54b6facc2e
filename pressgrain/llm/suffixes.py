"""Exact removal of repeated byte strings through a distributed sort of sampled suffixes.

A string of `length` bytes that occurs twice holds, in both places, the same anchor: the position with the least hash of
eight bytes among its first `reach` positions. Only the suffixes that start at anchors are looked at, and of those only
the ones whose first bytes (the gram) occur at another anchor as well.

1. Each document gives its anchors with the hashes of gram and context (what a repeated string around the anchor can
   cover). Anchors whose whole context occurs again are settled at once: all that surrounds them is repeated. They are
   folded within a batch before the shuffle, so that copies and common passages cost one row per batch.
2. Where a gram has several contexts, one suffix of each is cut from its text. Tasks sort their suffixes, front-code them
   and exchange the runs; a loser tree merges the runs of a shard and compares only what lies behind the common prefix
   it knows of. Neighbours with a common prefix of a gram's length form groups, and within a group the places of the
   window that contain the anchor are matched by window hashes.
3. Spans are joined to their documents, where their union is cut out.

Documents are told apart by 96 bits of hashes of their text, so equal texts, repeated rows and null ids need no care.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import saved, slices

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Suffixes in one run of the exchange, and in one shard on average.
RUN_ROWS, SHARD_ROWS = 20_000, 30_000
#: One more value per byte for window hashes, so that they don't depend on small byte values.
BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(v)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(text: bytes, length: int, reach: int) -> np.ndarray:
    """Positions that are the least of the first `reach` positions of some window of `length` bytes, ties included."""
    if len(text) < length:
        return np.empty(0, np.int64)
    v = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,)) * MIX
    v ^= v >> np.uint64(32)
    v *= MIX
    v = v[: len(text) - length + reach]
    least = _least(v, reach)
    around = np.zeros(len(v) + reach - 1, np.uint64)
    around[reach - 1 : reach - 1 + len(least)] = least
    return np.flatnonzero(~_least(~around, reach)[: len(v)] == v)


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of (common prefix with the one before, string) by a loser tree: (run, place in it, common prefix
    with the string put out before). Strings of one merge have the same length.

    Every waiting string carries its common prefix with the last one put out. The longer one is smaller; only if they are
    equal are bytes compared, from there on, and the loser then carries its common prefix with the winner.
    """
    many = len(runs)
    width = 1 << max(0, (many - 1).bit_length())
    at = [0] * width
    now: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (width - many)
    shared = [0] * width
    losers = [0] * width

    def duel(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h, k = shared[a], shared[b]
        if h != k:
            return (a, b) if h > k else (b, a)
        u, v = x[h:], y[h:]
        if u == v:
            shared[b] = len(y)
            return a, b
        same = len(u) - ((int.from_bytes(u, "big") ^ int.from_bytes(v, "big")).bit_length() + 7) // 8 + h
        if u < v:
            shared[b] = same
            return a, b
        shared[a] = same
        return b, a

    level = list(range(width))
    node = width
    while len(level) > 1:
        node //= 2
        following = []
        for k in range(0, len(level), 2):
            winner, losers[node + k // 2] = duel(level[k], level[k + 1])
            following.append(winner)
        level = following
    winner = level[0]
    while now[winner] is not None:
        yield winner, at[winner], shared[winner]
        lcps, strings = runs[winner]
        at[winner] += 1
        if at[winner] < len(strings):
            now[winner], shared[winner] = strings[at[winner]], lcps[at[winner]]
        else:
            now[winner] = None
        node = (winner + width) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2


def common_prefixes(strings: list[bytes]) -> list[int]:
    """Of each sorted string with the one before."""
    out = [0] if strings else []
    for a, b in zip(strings, strings[1:]):
        x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        out.append(len(b) - (x.bit_length() + 7) // 8)
    return out


def _window_spans(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the largest and the least number of bytes before the anchor at which a window of `length` bytes
    occurs in another context of its group; -1 where none does. Contexts are `reach` - 1 bytes before and `length` from
    the anchor on, of which `left` and `right` bytes exist."""
    span = reach - 1
    most, least = np.full(len(group), -1), np.full(len(group), -1)
    power = np.uint64(pow(int(BASE), length, 2**64))
    prefix = np.zeros((context.shape[1] + 1, len(group)), np.uint64)
    for k in range(context.shape[1]):
        prefix[k + 1] = prefix[k] * BASE + BYTES[context[:, k]]
    salt = group.astype(np.uint64) * MIX
    for before in range(span + 1):
        at = span - before
        usable = np.flatnonzero((before <= left) & (length - before <= right))
        if len(usable) < 2:
            continue
        value = (prefix[at + length] - prefix[at] * power)[usable] + salt[usable]
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        same = ordered[1:] == ordered[:-1]
        hit = usable[order[np.r_[False, same] | np.r_[same, False]]]
        most[hit] = before
        least[hit] = np.where(least[hit] < 0, before, least[hit])
    return most, least


def _found_anchors(length: int, reach: int):
    gram = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        names = ["at", "context", "k1", "k2", "place"]
        for batch in slices(batches, 1024):
            where, context, owner, place = [], [], [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for a in anchors(raw, length, reach).tolist():
                    left, right = min(reach - 1, a), min(length, len(raw) - a)
                    where.append(digest(raw[a : a + gram]))
                    context.append(digest(raw[a - left : a + right], left))
                    owner.append(row)
                    place.append(a << 10 | right << 2)
            if not where:
                continue
            where, context = np.array(where, np.uint64), np.array(context, np.uint64)
            place, owner = np.array(place, np.int64), np.array(owner)
            k1, k2 = (batch.column(k).to_numpy()[owner] for k in (1, 2))
            order = np.lexsort((context, where))
            same = (where[order][1:] == where[order][:-1]) & (context[order][1:] == context[order][:-1])
            again, first = np.r_[False, same], np.r_[same, False]
            settled, twice = order[again], order[first & ~again]
            place[twice] |= 1  # stands for others of this batch
            place[settled] |= 2  # known to be repeated, only passes through
            at = where.view(np.int64).copy()
            at[settled], context[settled] = k1[settled], 0
            columns = (at, context.view(np.int64), k1, k2, place)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _sorted_out(length: int, reach: int):
    """Of rows sorted by gram and context: spans of settled anchors (`kind` 0), and the anchors to compare (`kind` 1 and,
    where the span is settled already, 2)."""
    names = ["kind", "gram", "k1", "k2", "low", "high"]

    def made(at, context, k1, k2, place):
        passing = (place & 2) > 0
        pos, right = place >> 10, (place >> 2) & 255
        low, high = np.maximum(pos - (reach - 1), 0), pos + right
        g, c, w = at[~passing], context[~passing], (1 + (place & 1))[~passing]
        new_g = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
        new_c = new_g | np.r_[True, c[1:] != c[:-1]] if len(g) else new_g
        sub = np.cumsum(new_c) - 1
        run = np.cumsum(new_g) - 1
        full = (np.bincount(sub, w) > 1)[sub] if len(g) else new_g
        several = (np.bincount(run, new_c) > 1)[run] if len(g) else new_g
        ids = np.flatnonzero(~passing)
        spans = np.concatenate([np.flatnonzero(passing), ids[full]])
        asked = ids[several & new_c]
        kind = np.concatenate([np.zeros(len(spans), np.int32), np.where(full[several & new_c], 2, 1).astype(np.int32)])
        rows = np.concatenate([spans, asked])
        where = np.where(kind == 0, low[rows], pos[rows])
        columns = (kind, at[rows], k1[rows], k2[rows], where.astype(np.int32), high[rows].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            whole = np.searchsorted(rows[0], rows[0][-1])  # the last gram may go on in the next batch
            if whole:
                yield made(*(x[:whole] for x in rows))
            kept = [x[whole:] for x in rows]
        if kept is not None:
            yield made(*kept)

    return run


RUN_SCHEMA = "shard int, lcps binary, tails binary, before binary, sides binary, owners binary"


def _cut_runs(length: int, reach: int, shards: int):
    """Sorted, front-coded runs per shard of the suffixes that the joined rows ask for."""
    span = reach - 1

    def flush(waiting: list[tuple]) -> pa.RecordBatch:
        waiting.sort(key=lambda x: (x[0], x[1]))
        rows = []
        shard_of = np.array([x[0] for x in waiting])
        for low, high in zip(*(np.searchsorted(shard_of, np.unique(shard_of), side) for side in ("left", "right"))):
            part = waiting[low:high]
            strings = [x[1] for x in part]
            lcps = common_prefixes(strings)
            tails = b"".join(s[h:] for s, h in zip(strings, lcps))
            sides = np.array([x[3] for x in part], np.int32)
            owners = np.array([x[4] for x in part], np.int64)
            rows.append((part[0][0], np.array(lcps, np.int32).tobytes(), tails, b"".join(x[2] for x in part), sides.tobytes(), owners.tobytes()))
        names = RUN_SCHEMA.replace(" binary", "").replace(" int", "").split(", ")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for text, k1, k2, asked in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                raw = text.encode("utf-8", "surrogatepass")
                for x in asked:
                    a, settled = x["pos"], x["kind"] == 2
                    left, right = min(span, a), min(length, len(raw) - a)
                    suffix = raw[a : a + length].ljust(length, b"\0")
                    before = raw[a - left : a].rjust(span, b"\0")
                    waiting.append((x["gram"] % shards, suffix, before, (left, right, settled), (k1, k2, a)))
            if len(waiting) >= RUN_ROWS:
                yield flush(waiting)
                waiting = []
        if waiting:
            yield flush(waiting)

    return run


def _merged_spans(length: int, reach: int):
    gram, span = length - reach + 1, reach - 1

    def spans(runs: list[tuple]) -> pa.RecordBatch:
        decoded, before, sides, owners = [], [], [], []
        for lcps, tails, left, side, owner in runs:
            h = np.frombuffer(lcps, np.int32).tolist()
            strings, at, last = [], 0, b""
            for common in h:
                last = last[:common] + tails[at : at + length - common]
                at += length - common
                strings.append(last)
            decoded.append((h, strings))
            before.append(np.frombuffer(left, np.uint8).reshape(-1, span))
            sides.append(np.frombuffer(side, np.int32).reshape(-1, 3))
            owners.append(np.frombuffer(owner, np.int64).reshape(-1, 3))
        order = np.array(list(merge_runs(decoded)), np.int64).reshape(-1, 3)
        base = np.cumsum([0, *(len(d[1]) for d in decoded)])
        rows = base[order[:, 0]] + order[:, 1]
        group = np.cumsum(order[:, 2] < gram)
        suffix = np.frombuffer(b"".join(decoded[r][1][i] for r, i, _ in order.tolist()), np.uint8).reshape(-1, length)
        before, sides, owners = (np.concatenate(x)[rows] for x in (before, sides, owners))
        found: list[np.ndarray] = []
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else np.empty(0, np.int64)
        low = 0
        while low < len(group):  # whole groups, some ten thousand suffixes at a time
            high = int(ends[min(np.searchsorted(ends, low + 20_000), len(ends) - 1)])
            part = slice(low, high)
            most, least = _window_spans(group[part], np.concatenate([before[part], suffix[part]], axis=1), sides[part, 0], sides[part, 1], length, reach)
            hit = np.flatnonzero((most >= 0) & (sides[part, 2] == 0))
            own = owners[part][hit]
            found.append(np.stack([own[:, 0], own[:, 1], own[:, 2] - most[hit], own[:, 2] + length - least[hit]], axis=1))
            low = high
        k1, k2, start, end = np.concatenate(found or [np.empty((0, 4), np.int64)]).T
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["k1", "k2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, runs = None, []
        for batch in batches:
            for own, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard and runs:
                    yield spans(runs)
                    runs = []
                shard = own
                runs.append(tuple(rest))
        if runs:
            yield spans(runs)

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of a document's spans, and its bytes without them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches, 1024):
        sizes, spans, kept = [], [], []
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
            raw = text.encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            if not packed.is_valid:
                spans.append([])
                kept.append(raw)
                continue
            value = np.sort(packed.values.to_numpy())
            low, high = value >> 32, np.maximum.accumulate(value & 0xFFFFFFFF)
            first = np.r_[True, low[1:] > high[:-1]]
            starts, ends = low[first].tolist(), high[np.r_[first[1:], True]].tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.shiftright(F.xxhash64(F.lit(1), text), 32).cast("int").alias("k2")]


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_bytes`, `spans` (array of start and end, maximal and in order) and `kept` (binary) of every row.

    Texts are taken as UTF-8 bytes, null as empty. Every byte is cut out that a string of `length` bytes covers which also
    starts anywhere else in the table, overlapping places of one text included; all strings are judged on the input.
    Strings never reach across rows. Repeated rows are copies of each other; null ids stay; other columns are ignored.
    `length` is 255 at most.
    """
    reach = length - gram + 1
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), *_keys(text))
    found = rows.select("text", "k1", "k2").mapInArrow(_found_anchors(length, reach), "at long, context long, k1 long, k2 int, place long")
    dealt = found.repartition("at").sortWithinPartitions("at", "context")
    sorted_out = saved(dealt.mapInArrow(_sorted_out(length, reach), "kind int, gram long, k1 long, k2 int, low int, high int"), "anchors")
    asked = sorted_out.where("kind > 0")
    shards = max(1, -(-asked.count() // SHARD_ROWS))
    wanted = asked.groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", F.col("low").alias("pos"), "kind")).alias("asked"))
    runs = rows.join(wanted, ["k1", "k2"]).select("id", "text", "k1", "k2", "asked").mapInArrow(_cut_runs(length, reach, shards), RUN_SCHEMA)
    merged = runs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_merged_spans(length, reach), "k1 long, k2 int, low int, high int")
    spans = sorted_out.where("kind = 0").select("k1", "k2", "low", "high").unionByName(merged)
    packed = F.shiftleft(F.col("low").cast("long"), 32).bitwiseOR(F.col("high").cast("long"))
    per_text = spans.groupBy("k1", "k2").agg(F.collect_set(packed).alias("packed"))
    joined = rows.join(per_text, ["k1", "k2"], "left").select("id", "text", "packed")
    schema = f"id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    return joined.mapInArrow(_cut_out, schema).withColumnRenamed("id", id_col)
