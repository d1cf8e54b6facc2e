"""Packing token pieces into sequences of a fixed capacity: best fit, then swap-based local search.

Documents become byte-level BPE ids plus an end id, and documents over the capacity are cut. Full pieces are sequences
already. The others are dealt at random over groups of bounded size; each group is packed by best fit, and a local search
then takes bins from the emptiest on and moves a document, exchanges one for one, or two for one, whenever that raises the
sum of squared fills, until bins empty. Bins that stay loose in any group meet again in the next round, so what is lost
is a few bins of the last group and not of every group.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import saved, slices

#: The public pre-tokenizer of this kind of vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 200_000


class ByteBpe:
    """Ids of a byte-level BPE file as the tokenizers library gives them.

    A text is cut before every single space that follows another character, where a pre-token always begins, and each
    word is encoded once per worker. Texts with longer runs of blanks or an added token go to the library whole. Words
    of common Latin letters are merged by the rank encoder of the same vocabulary, which is faster; others by the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.odd = re.compile("|".join([r"\s ", *added]))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = dict(zip(shown, map(chr, shown)))
        letter.update(zip((b for b in range(256) if b not in letter), map(chr, range(256, 512))))
        byte = {c: b for b, c in letter.items()}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if not re.fullmatch("|".join(added) or "(?!)", piece)}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.kept = _Known(self._words, KEPT_WORDS)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has.

        Words that begin with a blank, end with none and have common letters are encoded as one text: no pre-token crosses
        the blank before a word, so the bytes of the ids tell where each word ends.
        """
        joins = [len(w) > 1 and w[0] == " " and not w[-1].isspace() for w in words]
        if max(map(max, filter(None, words)), default="") >= "ɐ":
            joins = [j and max(w) < "ɐ" for j, w in zip(joins, words)]
        together = [w for w, j in zip(words, joins) if j]
        flat = self.fast.encode_to_numpy("".join(together)).astype(np.int32) if together else np.empty(0, np.int32)
        ends = np.cumsum(np.fromiter((len(w.encode()) for w in together), np.int64, len(together)))
        stops = np.searchsorted(np.cumsum(self.sizes[flat]), ends, "right")
        count = np.zeros(len(words), np.int64)
        count[np.array(joins, bool)] = np.diff(stops, prepend=0)
        if len(together) == len(words):
            return flat, count
        alone = [k for k, j in enumerate(joins) if not j]
        parts = [self._alone(words[k]) for k in alone]
        count[alone] = [len(p) for p in parts]
        out = np.empty(count.sum(), np.int32)
        own = np.repeat(np.array(joins, bool), count)
        out[own] = flat
        out[~own] = [i for p in parts for i in p]
        return out, count

    def _alone(self, word: str) -> list[int]:
        return self.fast.encode_ordinary(word) if not word or max(word) < "ɐ" else self.whole.encode(word, add_special_tokens=False).ids

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has; null counts as empty."""
        plain = [not t or not self.odd.search(t) for t in texts]
        words = []
        for text, simple in zip(texts, plain):
            own = text.split(" ") if text and simple else []
            # Words are known by what follows their blank; a text's first word has none and gets a mark instead.
            if own and own[0]:
                own[0] = FIRST + own[0]
            elif own:
                del own[0]
            words.append(own)
        flat, count = self.kept.ids(words)
        odd = [i for i, simple in enumerate(plain) if not simple]
        if not odd:
            return flat, count
        parts = np.split(flat, np.cumsum(count)[:-1])
        for i in odd:
            parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One id array per text; null counts as empty."""
        flat, count = self.flat(texts)
        return np.split(flat, np.cumsum(count)[:-1])


FIRST = "\ud800"  # half a surrogate pair stands in no valid text


class _Numbers(dict):
    """Numbers of words in order of first sight; new ones are noted."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


class _Known:
    """Ids of the words that this worker has seen, each encoded once; starts anew beyond `limit` words."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.numbers, self.pool = _Numbers(), np.empty(0, np.int32)
        self.starts, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > self.limit:
            self.forget()
        sizes = [len(words) for words in texts]
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        if self.numbers.fresh:
            fresh = [w[1:] if w.startswith(FIRST) else " " + w for w in self.numbers.fresh]
            self.numbers.fresh = []
            flat, count = self.encode(fresh)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(count) - count])
            self.lens = np.concatenate([self.lens, count])
            self.pool = np.concatenate([self.pool, flat])
        lens = self.lens[at]
        before = np.cumsum(lens) - lens
        flat = self.pool[np.arange(lens.sum()) + np.repeat(self.starts[at] - before, lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([0, *sizes])]
        return flat, np.diff(ends)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, rows: int = 512) -> DataFrame:
    """One row per piece: `id_col`, `piece`, `start`, `length`, `ids_crc32` and, if wanted, `ids`.

    A null or empty text is the end id alone. Longer documents than the capacity are cut into full pieces but for the
    first, which takes what is left over. Null ids stay null, repeated rows give pieces each, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = vocabulary(file)
        for batch in slices(batches, rows):
            own, count = bpe.flat(batch.column(1).to_pylist())
            ends = np.cumsum(count + 1)
            ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
            ids[np.arange(len(own)) + np.repeat(np.arange(len(count)), count)] = own
            source, piece, start, length, crc, kept, raw = [], [], [], [], [], [], memoryview(ids.tobytes())
            for row, (n, end) in enumerate(zip((count + 1).tolist(), ends.tolist())):
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    source.append(row), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * (end - n + a) : 4 * (end - n + b)]))
                    if with_ids:
                        kept.append(ids[end - n + a : end - n + b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.kept.forget()  # the worker may serve other stages

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it. One big integer has a bit per free
    space in use, so the smallest that suffices is its lowest set bit."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    free = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        enough = free >> size
        if enough:
            space = (enough & -enough).bit_length() - 1 + size
            at = by_free[space].pop()
            if not by_free[space]:
                free &= ~(1 << space)
            bins[at].append(item)
        else:
            space, at = capacity, len(bins)
            bins.append([item])
        if left := space - size:
            by_free.setdefault(left, []).append(at)
            free |= 1 << left
    return bins


def _offers(items: list[int], lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """What a bin could give back for what it takes: nothing, one item or two; as (first, second, size), one per size."""
    ordered = sorted(items, key=lambda i: lengths[i])
    sizes: dict[int, tuple[int, int]] = {0: (-1, -1)}
    for i in ordered:
        sizes.setdefault(int(lengths[i]), (i, -1))
    for a, i in enumerate(ordered):
        if a < 2 or lengths[i] != lengths[ordered[a - 2]]:  # a third equal item makes no new pair
            for j in ordered[a + 1 :]:
                sizes.setdefault(int(lengths[i] + lengths[j]), (i, j))
    return [(i, j, size) for size, (i, j) in sizes.items()]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that raise the sum of squared fills; ends when no bin has such a step left or
    when the free space together is less than a bin."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    offers = {at: _offers(items, lengths) for at, items in enumerate(bins) if fill[at] < capacity}
    stuck: set[int] = set()
    flat = None
    while True:
        gap = np.where(fill > 0, capacity - fill, 0)
        if gap.sum() < capacity:
            break
        if flat is None:
            rows = [(at, *o) for at, given in offers.items() for o in given]
            flat = np.array(rows, np.int64).reshape(-1, 4).T
            room, level = gap[flat[0]], fill[flat[0]]
            queue = sorted((i for i in offers if i not in stuck), key=lambda i: (fill[i], i))
        if not queue:
            break
        donor = queue.pop(0)
        where, one, two, back = flat
        own = bins[donor]
        best = (0, None)
        for first, second, size in offers[donor][1:]:
            gain = size - back
            fits = (gain > 0) & (gain <= room) & (where != donor)
            if second >= 0:
                fits &= (one >= 0) & (two < 0)
            better = np.where(fits, gain * (level - fill[donor] + gain), 0)
            k = int(better.argmax())
            if better[k] > best[0]:
                best = (better[k], (first, second, k, int(gain[k])))
        if best[1] is None:
            stuck.add(donor)
            continue
        first, second, k, gain = best[1]
        to = int(where[k])
        given = [i for i in (first, second) if i >= 0]
        taken = [int(i) for i in (one[k], two[k]) if i >= 0]
        bins[donor] = [i for i in own if i not in given] + taken
        bins[to] = [i for i in bins[to] if i not in taken] + given
        fill[donor] -= gain
        fill[to] += gain
        for at in (donor, to):
            offers.pop(at, None)
            if 0 < fill[at] < capacity:
                offers[at] = _offers(bins[at], lengths)
        stuck -= {donor, to}
        flat = None
    return [b for b in bins if b]


def pack_group(lengths: np.ndarray, capacity: int, given: np.ndarray | None = None) -> list[list[int]]:
    """Bins of item numbers for one group, from best fit or from the bins the items came in, whichever are fewer."""
    bins = best_fit(lengths, capacity)
    if given is not None and len(given):
        _, at = np.unique(given, return_inverse=True)
        if at.max() + 1 < len(bins):
            order = np.argsort(at, kind="stable")
            bins = [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1)]
    return local_search(bins, lengths, capacity)


def _settle(step: int, capacity: int):
    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__row", ignore_index=True)
        lengths = frame["length"].to_numpy(np.int64)
        old = frame["__bin"].to_numpy() if step > 1 else None
        first = (step << 58) + (int(frame["__group"].iloc[0]) << 20)
        sequence, offset, free = (np.zeros(len(frame), np.int64) for _ in range(3))
        for number, members in enumerate(pack_group(lengths, capacity, old)):
            sizes = lengths[members]
            sequence[members], offset[members] = first + number, np.cumsum(sizes) - sizes
            free[members] = capacity - sizes.sum()
        return frame.drop(columns=["__bin", "__group"]).assign(__bin=sequence, offset=offset, __free=free)

    return settle


def pack(items: DataFrame, capacity: int = 1024, group_rows: int = 4096, loose: float = 0.05, apart: tuple[str, ...] = ()) -> DataFrame:
    """`items` (any columns, `length` from 1 to the capacity) plus `sequence_id` and `offset`, gapless from 0.

    Rows of the capacity itself are sequences of their own. The rest is dealt over groups of about `group_rows` rows; the
    bins a group leaves with more than the share `loose` free go into the next round, until they fit one group or no
    longer halve in number. Repeated rows are separate items. An empty table gives an empty result. Rows whose length is
    null, under 1 or over the capacity raise an error. Columns named in `apart` stay out of the rounds and are joined to the
    places at the end.
    """
    wrong = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    checked = items.withColumn("length", F.when(wrong, F.raise_error("piece length outside the capacity").cast("long")).otherwise(F.col("length").cast("long")))
    base = saved(checked.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in base.columns if c != "__row"]
    slim = [c for c in columns if c not in apart]
    done = base.where(F.col("length") == capacity).select(*columns, F.col("__row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = base.where(F.col("length") < capacity).select(*slim, "__row", F.lit(None).cast("long").alias("__bin"))
    kept, placed = base.where(F.col("length") < capacity).select("__row", *apart), []
    count, step = todo.count(), 1
    while count:
        groups = max(1, round(count / group_rows))
        key = F.coalesce("__bin", "__row")  # a loose bin stays together
        dealt = todo.withColumn("__group", F.pmod(F.xxhash64(key, F.lit(step)), F.lit(groups)))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields if f.name != "__bin")

        packed = saved(dealt.groupBy("__group").applyInPandas(_settle(step, capacity), f"{schema}, __bin long, offset long, __free long"), "packed")
        is_loose = F.col("__free") > loose * capacity
        left = packed.where(is_loose).count() if groups > 1 else 0
        final = left == 0 or left > count / 2
        ready = packed if final else packed.where(~is_loose)
        placed.append(ready.select(*slim, "__row", F.col("__bin").alias("sequence_id"), "offset"))
        if final:
            break
        todo = packed.where(is_loose).select(*slim, "__row", "__bin")
        count, step = left, step + 1
    if placed:
        rest = reduce(DataFrame.unionByName, placed)
        done = done.unionByName((rest.join(kept, "__row") if apart else rest).select(*done.columns))
    return done


def pack_documents(docs: DataFrame, file: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """`pieces` of all documents packed by `pack`; the ids, if wanted, meet their places after the last round."""
    return pack(pieces(docs, file, capacity, end_id, id_col, text_col, with_ids), capacity, apart=("ids",) * with_ids)
