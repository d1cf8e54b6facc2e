"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Texts are cut into words where no piece of the vocabulary can reach across: before a space mark that follows another
character, and around characters that occur in no longer piece. All words of a batch that are not known yet lie in one
flat array of symbols. A round finds the best pair of every word (a segmented minimum of pair ranks), merges all its
occurrences from the left at once, and drops words in which no pair is left. Merging several occurrences at once equals
the library's one-by-one order unless the new piece could take part in a better-ranked pair; for such pieces only the
leftmost occurrence is merged in a round. Words are independent, so their ids are kept in a bounded table per worker.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressgrain.llm.common import KnownWords, slices

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words kept per worker; beyond it the table starts anew. Only speed depends on it.
KEPT_WORDS = 400_000


def _each_byte(error):
    return "�", error.start + 1


codecs.register_error("each_byte", _each_byte)


class Pieces:
    """The vocabulary of one model file as arrays. Models other than BPE with identity normalisation are refused."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(self.size)]
        if model.encode("  ÄＡ  b ") != model.encode("  ÄＡ  b ", enable_sampling=False) or model.decode(model.encode("  Ａ  b ")) != "  Ａ  b ":
            raise ValueError("the model normalises texts; only identity normalisation is supported")
        own = {name: i for i, name in enumerate(names) if not special[i]}
        if any(MARK in name.lstrip(MARK) for name in own):
            raise ValueError("a piece reaches across words")
        self.unknown = model.unk_id()
        self.bytes = np.full(256, self.unknown, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(names[i][3:-1], 16)] = i
        self.fallback = all(model.is_byte(int(i)) for i in self.bytes)
        self.char = {name: i for name, i in own.items() if len(name) == 1}
        score = {name: model.get_score(i) for name, i in own.items()}
        long = sorted((n for n in own if len(n) > 1), key=lambda n: -score[n])
        self.rank = np.full(self.size, NONE, np.int32)
        unsafe = np.zeros(self.size, bool)
        last = None
        for r, name in enumerate(long):
            self.rank[own[name]] = r
            if last is not None and score[last] == score[name]:
                self.rank[own[name]] = self.rank[own[last]]
                unsafe[own[name]] = unsafe[own[last]] = True
            last = name
        symbol = lambda s: own.get(s, self.size + ord(s) if len(s) == 1 else None)
        pairs = []
        for name in long:
            for cut in range(1, len(name)):
                x, y = symbol(name[:cut]), symbol(name[cut:])
                if x is not None and y is not None:
                    pairs.append((x, y, own[name]))
                    for part in (x, y):
                        if part < self.size and self.rank[part] != NONE and self.rank[own[name]] < self.rank[part]:
                            unsafe[part] = True
        self.unsafe = unsafe
        x, y, merged = (np.array(v, np.int64) for v in zip(*pairs))
        self._hash(x * 2_000_003 + y, merged.astype(np.int32))
        inner = {c for name in long for c in name}
        self.split_newline = "\n" not in inner
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.split_newline else f"{MARK}*[^{MARK}]+|{MARK}+")
        surfaces = [b"" if model.is_control(i) else " ⁇ ".encode() if i == self.unknown else bytes([int(n[3:-1], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_len = np.array([len(s) for s in surfaces], np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)[:-1]])
        self.marked = np.array([n.startswith(MARK) and not special[i] for i, n in enumerate(names)])
        self.kept = KnownWords(self.merge, KEPT_WORDS)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open table of pair keys: 2**bits slots, linear probing of at most `probes` steps."""
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        slots = np.full(1 << self.bits, -1, np.int64)
        found = np.full(1 << self.bits, -1, np.int32)
        todo, step = np.arange(len(keys)), 0
        home = self._slot(keys)
        while len(todo):
            at = (home[todo] + step) & ((1 << self.bits) - 1)
            free = slots[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            won = todo[free][first]
            slots[at[free][first]], found[at[free][first]] = keys[won], values[won]
            todo, step = np.setdiff1d(todo, won), step + 1
        self.slots, self.found, self.probes = slots, found, step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair makes, -1 where it makes none."""
        keys = left.astype(np.int64) * 2_000_003 + right
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        slot = self.slots[at]
        hit = slot == keys
        out[hit] = self.found[at[hit]]
        open_ = np.flatnonzero(~hit & (slot >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            near = (at[open_] + step) & ((1 << self.bits) - 1)
            slot = self.slots[near]
            hit = slot == keys[open_]
            out[open_[hit]] = self.found[near[hit]]
            open_ = open_[~hit & (slot >= 0)]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many each word has."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        table = np.array([self.char.get(chr(c), self.size + int(c)) for c in distinct], np.int32)
        sym = table[back] if len(points) else np.empty(0, np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            made = np.full(len(sym), -1, np.int32)
            made[:-1] = self._merged(sym[:-1], sym[1:])
            made[:-1][word[:-1] != word[1:]] = -1
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.r_[first, len(sym)])
            rest = best == NONE
            if rest.any():
                over = np.repeat(rest, span)
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, made, rank, best, span = sym[keep], word[keep], made[keep], rank[keep], best[~rest], span[~rest]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(best, span))
            begin = np.r_[True, np.diff(pick) > 1]
            run = np.maximum.accumulate(np.where(begin, pick, 0))
            pick = pick[(pick - run) % 2 == 0]
            risky = self.unsafe[made[pick]]
            if risky.any():
                leftmost = np.r_[True, word[pick[1:]] != word[pick[:-1]]]
                pick = pick[leftmost | ~risky]
            sym[pick] = made[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        strange = np.flatnonzero(sym >= self.size)
        if len(strange):
            many = np.ones(len(sym), np.int64)
            fill = [self.bytes[list(chr(c - self.size).encode())] if self.fallback else [self.unknown] for c in sym[strange]]
            many[strange] = [len(f) for f in fill]
            at = np.cumsum(many) - many
            word = np.repeat(word, many)
            out = np.repeat(sym, many)
            for i, f in zip(at[strange], fill):
                out[i : i + len(f)] = f
            sym = out
        return sym, np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has. Null counts as empty; empty gives no ids."""
        cut = self.words.findall
        return self.kept.ids([cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        """The text of one id sequence: one leading space of the first piece goes, byte pieces join to characters."""
        if not len(ids):
            return ""
        lens = self.surface_len[ids]
        before = np.cumsum(lens) - lens
        raw = self.surface[np.arange(lens.sum()) + np.repeat(self.surface_at[ids] - before, lens)].tobytes()
        said = np.flatnonzero(lens > 0)
        if len(said) and self.marked[ids[said[0]]]:
            raw = raw[1:]
        return raw.decode("utf-8", "each_byte")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """`id_col`, `ids` (array of int) of every row: the whole text as the library encodes it, without begin or end id.

    A null or empty text gives an empty array; a null id stays null; repeated rows are encoded each; other columns are
    ignored, whatever their names. Rows stay where they are: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary = pieces(model)
        for batch in slices(batches, rows):
            flat, count = vocabulary.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", rows: int = 512) -> DataFrame:
    """`id_col`, `ids`, `decoded` of every row. Null or empty ids give an empty text; ids outside the model fail."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary = pieces(model)
        for batch in slices(batches, rows):
            column = batch.column(1)
            ends = np.asarray(column.offsets)
            values = np.asarray(column.values)
            texts = [vocabulary.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    ids = encoded.selectExpr(f"`{id_col}` id", f"coalesce(cast(`{ids_col}` as array<int>), cast(array() as array<int>)) ids")
    return ids.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
