"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of two inputs' projections: its own embedding (words of the training sample; others share one)
and the mean embedding of its character trigrams. Windows of words overlap by a third and cover the whole text; each is read
in both directions, attention pools the states, and the text's score is that of its worst window. Labels mark whole texts,
so training looks for the worst window of each labelled text and learns from that one. As a word's projections do not
depend on its place, they are computed once per distinct word and worker.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.llm.common import slices

WINDOW, STRIDE = 48, 32
WIDTH, HIDDEN = 8, 8
TRIGRAMS = 4096
EDGE = ".,;:!?\"'()[]{}<>*#%&$|-_"
KEPT_WORDS = 250_000
BATCH = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _trigrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, marked at both ends, in one flat array; where each word's begin."""
    marked = [f"\x02{w}\x03" if w else "\x02 \x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    mixed = points[:-2] * 961 + points[1:-1] * 31 + points[2:]
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(points), bool)
    for last in (1, 2):
        keep[starts + sizes - last] = False
    return (mixed * 2654435761 >> 8)[keep[:-2]] % TRIGRAMS, np.cumsum(sizes - 2) - (sizes - 2)


def normal(token: str) -> str:
    return token.strip(EDGE).lower()


@dataclass
class Network:
    """Parameters; `vocabulary` maps the words of the sample to rows of `word` from 1 on, row 0 is every other word."""

    vocabulary: dict[str, int]
    word: np.ndarray
    char: np.ndarray
    inputs: np.ndarray  # (2 * WIDTH, 2 directions * 3 gates * HIDDEN)
    bias: np.ndarray
    forth: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    back: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)
    rows: np.ndarray | None = field(default=None, repr=False)

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.char, self.inputs, self.bias, self.forth, self.back, self.attend, self.out, self.shift]

    def embed(self, words: Sequence[str]) -> np.ndarray:
        ids, starts = _trigrams(words)
        many = np.diff(np.append(starts, len(ids)))[:, None]
        char = np.add.reduceat(self.char[ids], starts, axis=0) / many
        return np.concatenate([self.word[[self.vocabulary.get(w, 0) for w in words]], char], axis=1)

    def lookup(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """Rows of `self.rows` for the tokens of each text; new tokens are projected first."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.rows = {}, None
        fresh = list(set(chain.from_iterable(texts)).difference(self.known))
        if fresh:
            made = (self.embed([normal(w) for w in fresh]) @ self.inputs + self.bias).astype(np.float32)
            begin = len(self.known)
            if self.rows is None or begin + len(made) > self.rows.shape[1]:
                grown = np.zeros((2, max(2 * begin, begin + len(made)), 3 * HIDDEN), np.float32)
                if begin:
                    grown[:, :begin] = self.rows[:, :begin]
                self.rows = grown
            self.rows[:, begin : begin + len(made)] = made.reshape(len(made), 2, -1).transpose(1, 0, 2)
            self.known.update(zip(fresh, range(begin, begin + len(made))))
        sizes = [len(t) for t in texts]
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        return np.split(flat, np.cumsum(sizes)[:-1])

    def states(self, index: np.ndarray, live: np.ndarray | None, table: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, 2 * HIDDEN) of both directions over the projected words; `index` is (T, B), `table` (2, words, 3 * HIDDEN)."""
        steps, many = index.shape
        half = table.dtype.type(0.5)
        all_ = np.zeros((steps, many, 2 * HIDDEN), table.dtype)
        for side, (u, order) in enumerate(((self.forth, range(steps)), (self.back, range(steps - 1, -1, -1)))):
            h = np.zeros((many, HIDDEN), table.dtype)
            u = u.astype(table.dtype)
            own = table[side]
            for t in order:
                g, a = own.take(index[t], axis=0), h @ u
                zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
                zr *= half
                np.tanh(zr, out=zr)  # the logistic function by way of tanh
                zr *= half
                zr += half
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = r * a[:, 2 * HIDDEN :]
                n += g[:, 2 * HIDDEN :]
                np.tanh(n, out=n)
                before, h = h, h - n
                h *= z
                h += n
                if live is not None:
                    h = np.where(live[t][:, None], h, before)
                all_[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
                if keep is not None:
                    keep.append((side, t, before, z, r, n, a[:, 2 * HIDDEN :]))
        return all_

    def pool(self, states: np.ndarray, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = states @ self.attend.astype(states.dtype)
        if live is not None:
            score = np.where(live, score, -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ self.out.astype(states.dtype) + self.shift[0].astype(states.dtype), weight, pooled

    def windows(self, texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window, and the number of its text. Long texts end with a window that ends with the text."""
        owner, logit = [], []
        long = [(k, t) for k, t in enumerate(texts) if len(t) >= WINDOW]
        if long:
            starts = [np.append(np.arange(0, len(t) - WINDOW, STRIDE), len(t) - WINDOW) for _, t in long]
            base = np.cumsum([0, *(len(t) for _, t in long)])[:-1]
            flat = np.concatenate([t for _, t in long])
            where = np.concatenate([s + b for s, b in zip(starts, base)])
            owner.append(np.repeat([k for k, _ in long], [len(s) for s in starts]))
            for at in range(0, len(where), BATCH):
                index = flat[where[at : at + BATCH][None, :] + np.arange(WINDOW)[:, None]]
                logit.append(self.pool(self.states(index, None, self.rows), None)[0])
        short = sorted(((len(t), k) for k, t in enumerate(texts) if 0 < len(t) < WINDOW))
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            index, live = padded([texts[k] for _, k in part])
            logit.append(self.pool(self.states(index, live, self.rows), live)[0])
            owner.append(np.array([k for _, k in part]))
        none = [np.empty(0)]
        return np.concatenate(logit or none), np.concatenate(owner or none).astype(np.int64)

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Scores from 0 to 1 of whole texts; 0 for texts without words."""
        logit, owner = self.windows(self.lookup([(t or "").split() for t in texts]))
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, logit)
        return _sigmoid(np.clip(worst, -700, 700)) * (worst > -np.inf)


def padded(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, texts))
    index, live = np.zeros((steps, len(texts)), np.int64), np.zeros((steps, len(texts)), bool)
    for k, t in enumerate(texts):
        index[: len(t), k], live[: len(t), k] = t, True
    return index, live


def new_network(words: Sequence[str], seed: int = 11) -> Network:
    draw = np.random.default_rng(seed)
    normal_ = lambda *shape, scale=0.1: draw.normal(0, scale, shape)
    gates = 3 * HIDDEN
    return Network(
        {w: k + 1 for k, w in enumerate(words)}, normal_(len(words) + 1, WIDTH), normal_(TRIGRAMS, WIDTH), normal_(2 * WIDTH, 2 * gates, scale=0.3),
        np.zeros(2 * gates), normal_(HIDDEN, gates, scale=0.2), normal_(HIDDEN, gates, scale=0.2), normal_(2 * HIDDEN), normal_(2 * HIDDEN), np.zeros(1),
    )


def _gradients(net: Network, words: list[list[str]], target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted logistic loss over one window per text, in the order of `parameters`."""
    distinct = list({w for t in words for w in t})
    place = {w: k for k, w in enumerate(distinct)}
    index, live = padded([np.array([place[w] for w in t]) for t in words])
    x = net.embed(distinct)
    table = x @ net.inputs + net.bias
    keep: list = []
    states = net.states(index, live, table.reshape(len(table), 2, -1).transpose(1, 0, 2), keep)
    logit, share, pooled = net.pool(states, live)
    chance = _sigmoid(logit)
    dy = (chance - target) * weight / len(target)
    dc = dy[:, None] * net.out
    dstates = share[:, :, None] * dc
    dshare = np.einsum("tbh,bh->tb", states, dc)
    dscore = share * (dshare - (share * dshare).sum(axis=0))
    dattend = np.einsum("tb,tbh->h", dscore, states)
    dstates += dscore[:, :, None] * net.attend
    dtable, du = np.zeros_like(table), [np.zeros_like(net.forth), np.zeros_like(net.back)]
    dh = [np.zeros((len(words), HIDDEN))] * 2
    for side, t, before, z, r, n, an in reversed(keep):
        on = live[t][:, None]
        total = dh[side] + dstates[t, :, side * HIDDEN : (side + 1) * HIDDEN]
        d = np.where(on, total, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        u = (net.forth, net.back)[side]
        du[side] += before.T @ da
        dh[side] = np.where(on, d * z + da @ u.T, total)
        np.add.at(dtable[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN], index[t], np.concatenate([dz, dr, dn], axis=1))
    dx = dtable @ net.inputs.T
    dword, dchar = np.zeros_like(net.word), np.zeros_like(net.char)
    np.add.at(dword, [net.vocabulary.get(w, 0) for w in distinct], dx[:, :WIDTH])
    ids, starts = _trigrams(distinct)
    many = np.diff(np.append(starts, len(ids)))
    np.add.at(dchar, ids, np.repeat(dx[:, WIDTH:] / many[:, None], many, axis=0))
    loss = float(-(weight * np.where(target > 0, np.log(chance + 1e-12), np.log(1 - chance + 1e-12))).mean())
    return [dword, dchar, x.T @ dtable, dtable.sum(axis=0), *du, dattend, pooled.T @ dy, np.array([dy.sum()])], loss


def train(texts: Sequence[str], labels: Sequence[int], steps: int = 260, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """A network for texts marked 1 (toxic) or 0, by at least `steps` steps of Adam over the worst window
    of each text, balanced by class.

    The first round picks windows by the words' smoothed log odds, later ones by the network itself. Without texts of
    both classes the network stays untrained and scores every text as 0.
    """
    target = np.array(labels, np.float64)
    cleaned = [[intern(normal(w)) for w in t.split()] for t in texts]  # each distinct word is held once
    often = Counter(w for t in cleaned for w in set(t))
    net = new_network(sorted(w for w, n in often.items() if n > 3), seed)
    usable = [k for k, t in enumerate(cleaned) if t]
    if not usable or len({labels[k] for k in usable}) < 2:
        net.shift[:] = -1e3
        return net
    toxic = Counter(w for t, y in zip(cleaned, labels) if y for w in set(t))
    ones, zeros = float(target.sum()), float(len(target) - target.sum())
    odds = {w: n / (n + 3) * (np.log((toxic[w] + 0.5) / (ones + 1)) - np.log((n - toxic[w] + 0.5) / (zeros + 1))) for w, n in often.items() if n > 3}
    for w, k in net.vocabulary.items():
        net.word[k, 0] = np.clip(odds[w], -1, 3) * 0.3
    weight = np.where(target > 0, len(target) / (2 * ones), len(target) / (2 * zeros))
    draw = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step, turn = 0, -1
    while step < steps:
        turn += 1
        order = draw.permutation(usable)
        for at in range(0, len(order) if step < steps else 0, batch):
            part = order[at : at + batch]
            if turn == 0:
                worst = []
                for k in part:
                    value = np.array([max(odds.get(w, 0.0), 0.0) for w in cleaned[k]])
                    sums = np.convolve(value, np.ones(min(WINDOW, len(value))), "valid")
                    worst.append(cleaned[k][int(sums.argmax()) :][:WINDOW])
            else:
                net.known, net.rows = {}, None
                rows = net.lookup([cleaned[k] for k in part])
                logit, owner = net.windows(rows)
                worst = []
                for j, k in enumerate(part):
                    if len(cleaned[k]) < WINDOW:
                        worst.append(cleaned[k])
                        continue
                    number = int(logit[owner == j].argmax())
                    begin = min(number * STRIDE, len(cleaned[k]) - WINDOW)
                    worst.append(cleaned[k][begin : begin + WINDOW])
            grads, _ = _gradients(net, worst, target[part], weight[part])
            step += 1
            pace = rate * max(0.0, 1 - step / steps) + 1e-4
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.known, net.rows = {}, None
    return net


def held_out(id_column: Column) -> Column:
    """The fifth of all ids that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(id_column.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1000, clean_rows: int = 2500, longest: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most `toxic_rows` and `clean_rows` labelled texts of the two classes outside the held-out fold, in the order of a hash of the id.

    So that the sample is bounded in bytes too, texts of more than `longest` characters are not learnt from (all texts
    are scored). An id with several labels counts as toxic if any says so; null ids, texts and labels take no part.
    """
    marks = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("y")).dropna().where(~held_out(F.col("i")))
    marks = marks.groupBy("i").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    order = [F.xxhash64("i"), F.col("i")]
    picked = [marks.where(F.col("y") == y).orderBy(*order).limit(n) for y, n in ((0, clean_rows), (1, toxic_rows))]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # toxic_rows + clean_rows rows at most
    own = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"))
    rows = own.join(chosen, "i").where(F.length("t") <= longest).groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).orderBy("i").collect()
    return [r["t"] for r in rows], [r["y"] for r in rows]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """All columns of `docs` plus `score` (double from 0 to 1) and `predicted` (1 from 0.5 on), over all windows of the
    whole text. Null, empty and blank texts score 0. Repeated rows and null ids are scored like any other; columns named
    `score` or `predicted` are replaced. Only the text is an input."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", `score` double, `predicted` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, rows):
            value = own.score(batch.column(len(rest)).to_pylist())
            columns = [batch.column(k) for k in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32), pa.int32())], [*rest, "score", "predicted"])

    text = docs[text_col].cast("string").alias("__text")
    return docs.select(*[docs[c] for c in rest], text).mapInArrow(run, schema)


def in_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
