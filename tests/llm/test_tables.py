"""Operators that compare rows with each other: classes, repeats, neighbours and packing."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pressgrain.llm import ann, packing, paragraphs, secrets, simhash, suffixes, toxicity
from pressgrain.llm.common import components
from pressgrain.llm.queries import tokenizer_file
from tests.llm.fixtures import frame, texts, words

BYTES = tokenizer_file("byte_bpe_50k.json")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, 5), (7, 7)]])
def test_components(spark, edges):
    own = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            own.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r["node"], r["root"]) for r in components(df).collect()} == {(x, own.root(x)) for x in own.up}


def slow_fingerprint(text, words=4):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))] if own else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(spark):
    df = frame(spark)
    got = simhash.near_duplicates(df).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert len(got) == len(rows)
    marks = {t: slow_fingerprint(t) for _, t in rows}
    own = Union()
    for a in marks.values():
        for b in marks.values():
            if (a ^ b).bit_count() <= 4:
                own.join(a, b)
    least = collections.defaultdict(list)
    for i, t in rows:
        least[own.root(marks[t])].append(i)
    want = sorted((str(i), marks[t], min((x for x in least[own.root(marks[t])] if x is not None), default=None)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius,trees,cell_rows", [(4, 5, 20_000), (4, 4, 20_000), (4, 2, 20_000), (4, 5, 30), (0, 1, 10)])
def test_simhash_links_connect_what_all_pairs_do(spark, radius, trees, cell_rows):
    rng = random.Random(radius + trees)
    points = set()
    for _ in range(60):  # clusters in which members differ in some bits, and single points
        centre = rng.getrandbits(64)
        points.add(centre)
        for _ in range(rng.choice([0, 0, 3, 20])):
            x = centre
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in points], "fp long")
    got, want = Union(), Union()
    for r in simhash.links(df, radius, trees, cell_rows).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        assert (a ^ b).bit_count() <= radius
        got.join(a, b)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                want.join(a, b)
    assert [got.root(x) for x in points] == [want.root(x) for x in points]


def test_vantage_point_join_of_a_large_cell():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in centres] + [rng.integers(0, 2**63, 900, dtype=np.uint64)]))
    a, b = simhash.cell_links(np.zeros(len(x), np.int64), x, 4)
    got, want = Union(), Union()
    for p, q in zip(a.tolist(), b.tolist()):
        got.join(p, q)
    for i, p in enumerate(x):
        for q in x[:i][np.bitwise_count(x[:i] ^ p) <= 4].tolist():
            want.join(int(p), q)
    assert [got.root(int(p)) for p in x] == [want.root(int(p)) for p in x]


def slow_repeats(rows, length):
    where = collections.Counter()
    raws = [(t or "").encode() for t in rows]
    for raw in raws:
        where.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if where[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((bytes(np.frombuffer(raw, np.uint8)[~gone]), int(gone.sum())))
    return out


@pytest.mark.parametrize("length,gram", [(200, 50), (40, 12)])
def test_suffix_removal_equals_brute_force(spark, length, gram):
    rng = random.Random(length)
    rows = [*enumerate(texts()), (None, "no id"), (9, texts()[9])]
    pool = "".join(rng.choice("abé ") for _ in range(900))
    for k in range(60):  # pieces of one text, cut at all places, with and without changes
        a, b = sorted((rng.randrange(900), rng.randrange(900)))
        piece = pool[a:b]
        rows.append((100 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + piece + ("q" if k % 2 else "") + pool[: rng.randrange(300)]))
    got = suffixes.remove_repeats(frame(spark, rows), length, gram).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    want = [(i, kept, n) for (i, _), (kept, n) in zip(rows, slow_repeats([t for _, t in rows], length))]
    assert sorted([(r["doc_id"], bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert suffixes.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(8)
    for many in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randrange(12))) for _ in range(many)]
        coded = [(suffixes.common_prefixes(r), r) for r in runs]
        out = list(suffixes.merge_runs(coded))
        strings = [runs[r][i] for r, i, _ in out]
        assert strings == sorted(x for r in runs for x in r)
        for (a, b), (_, _, h) in zip(zip(strings, strings[1:]), out[1:]):
            assert h == next((k for k in range(6) if a[k] != b[k]), 6)


def slow_paragraphs(rows, least=20, similar=0.8):
    where = collections.defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= least:
                where[" ".join(line.split())].append(((i is None, i or 0), t, k))
    sets = {p: {tuple(p.split()[j : j + 5]) for j in range(max(1, len(p.split()) - 4))} for p in where}
    own = Union()
    for a in sets:
        own.root(a)
        for b in sets:
            if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                own.join(a, b)
    classes = collections.defaultdict(set)
    for p, places in where.items():
        classes[own.root(p)] |= {(i, k) for i, _, k in places}
    return {x for places in classes.values() for x in sorted(places)[1:]}


def test_paragraph_removal_equals_brute_force(spark):
    rng = random.Random(12)
    base = [words(rng, 60) for _ in range(5)]
    rows = [*enumerate(texts()), (None, "no id\n" + base[0]), (9, texts()[9])]
    for k in range(40):
        own = [rng.choice(base).split(" ") for _ in range(rng.randint(1, 3))]
        for line in own:
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                line[rng.randrange(len(line))] = f"new{rng.randrange(1000)}"
        rows.append((200 + k, "\n".join([words(rng, 25), *(" ".join(line) for line in own), "short line"])))
    gone = slow_paragraphs(rows)
    for bucket_rows in (5_000, 3):
        for r in paragraphs.remove_repeats(frame(spark, rows), bucket_rows=bucket_rows).collect():
            text = next(t for i, t in rows if i == r["doc_id"])
            own = (r["doc_id"] is None, r["doc_id"] or 0)
            lines = [x for k, x in enumerate((text or "").split("\n")) if (own, k) not in gone]
            assert r["text"] == (None if text is None else "\n".join(lines)), r["doc_id"]
            assert r["n_removed"] == sum(x == own for x, _ in gone) and bool(r["kept_in"]) == bool(r["n_removed"])
    assert paragraphs.remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("relax", [1.0, 1.1])
def test_neighbours(spark, relax):
    rng = np.random.default_rng(3)
    vectors = [x.tolist() for x in rng.normal(size=(700, 16)) * rng.uniform(0.5, 2, (700, 1))]
    for k in range(50, 120):
        vectors[k] = vectors[40]  # ties
    vectors[3], vectors[4], vectors[5], vectors[6], vectors[20] = None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] * 16
    df = spark.createDataFrame([*((i, v, "x", 1) for i, v in enumerate(vectors)), (None, vectors[0], "x", 1)], "vec_id long, embedding array<float>, score string, rank int")
    got = collections.defaultdict(list)
    for r in ann.search(df, relax=relax, shard_rows=200, block=8).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[i] for i in usable], np.float32).astype(float)
    assert set(got) == {i for i in usable if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        score = np.array([np.dot(a, x[usable.index(q)]) for a in x])
        want = sorted((-round(s, 9), i) for i, s in zip(usable, score) if i != q)[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        hits, total = hits + len({i for _, i, _ in found} & {i for _, i in want}), total + 20
        if relax == 1:
            assert [(-round(s, 9), i) for _, i, s in found] == want
    assert hits >= 0.9 * total
    few = ann.search(df.where("vec_id in (0, 1, 2)"))
    assert few.count() == 2 and ann.search(df.limit(0)).count() == 0


def nearest_ids(rows, k=20, every=20):
    """Brute force: of each id divisible by `every`, the k ids of the best scores, smaller ids first."""
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for _, x in [r for r in rows if r[0] == q]:
            for i, y in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(x, y)))
        out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return out


def test_neighbours_of_equal_scores_and_of_repeated_ids(spark):
    """Scores that tie between different vectors go to smaller ids; repeated rows, and ids with several vectors, rank once."""
    rng = np.random.default_rng(8)
    small = [(i, rng.integers(-2, 3, 4).astype(float)) for i in range(900)]
    tied = [(i, np.array([1.0, float(i), float(i % 7)])) for i in range(1, 600)] + [(0, np.array([1.0, 0.0, 0.0]))]
    one = np.array([1.0, 2.0, 2.0])
    twice = [(0, one)] * 30 + [(5, one), (7, 3 * one), (8, -one)] + [(7, 2 * one)] * 30 + [(40, one + k) for k in range(25)]
    for rows in (small, tied, twice + [(100 + i, rng.integers(-1, 2, 3).astype(float)) for i in range(300)]):
        usable = [(i, x) for i, x in rows if x.any()]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<float>").repartition(3)
        got = collections.defaultdict(list)
        for r in ann.search(df, relax=1.0, shard_rows=300, block=8).collect():
            got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
        want = nearest_ids(usable)
        assert {q: [(s, i) for _, s, i in sorted(found)] for q, found in got.items()} == want


def test_packing_keeps_every_piece(spark):
    rows = [*enumerate(texts()), (None, "no id"), (9, texts()[9])]
    df = frame(spark, rows)
    got = packing.pack_documents(df, BYTES, capacity=64).collect()
    own = packing.ByteBpe(BYTES)
    want = []
    for i, t in rows:
        ids = np.append(own.whole.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4")
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(df.limit(0), BYTES).count() == 0


def test_packing_in_several_rounds(spark):
    rng = random.Random(2)
    sizes = [rng.choice([5, 30, 33, 60, 61, 100]) for _ in range(3000)]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, length long, offset_ string")
    bins = collections.Counter()
    seen = set()
    for r in packing.pack(items, capacity=100, group_rows=150).collect():
        bins[r["sequence_id"]] += r["length"]
        seen.add(r["doc_id"])
    whole = packing.pack_group(np.array(sizes), 100)
    assert max(bins.values()) <= 100 and len(seen) == 3000 and len(bins) <= 1.03 * len(whole)
    with pytest.raises(Exception, match="piece length"):
        packing.pack(spark.createDataFrame([(1, 101)], "doc_id long, length long"), capacity=100)


def test_local_search_empties_bins():
    lengths = np.array([60, 30, 45, 35, 50, 20, 40, 10])
    start = [[0, 1], [2, 3], [4, 5], [6], [7]]
    out = packing.local_search([list(b) for b in start], lengths, 100)
    assert sorted(i for b in out for i in b) == list(range(8)) and all(lengths[b].sum() <= 100 for b in out)
    assert len(out) == 3 or sum(lengths[b].sum() ** 2 for b in out) > sum(lengths[b].sum() ** 2 for b in start)
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = rng.integers(5, 70, 60)
        packed = packing.pack_group(sizes, 100)
        assert sorted(i for b in packed for i in b) == list(range(60)) and all(sizes[b].sum() <= 100 for b in packed)
        assert -(-sizes.sum() // 100) <= len(packed) <= len(packing.best_fit(sizes, 100))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    passage = words(rng, 70)
    rows, marks = [], []
    for i in range(150):
        own = words(rng, rng.randint(60, 120)).split(" ")
        if i % 3 == 0:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(own)))
        marks.append((i, int(i % 3 == 0), 1))
    rows += [(200, rows[1][1]), (201, rows[2][1] + "\n" + passage), (202, rows[4][1] + " more words here\n" + passage), (203, "password=verysecret " + rows[5][1]), (204, None), (205, "")]
    rows += [(None, rows[1][1]), (206, words(rng, 80)), (206, words(rng, 80)), (207, words(rng, 50)), (207, rows[7][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    net = toxicity.train(*toxicity.sample(docs, spark.createDataFrame(marks, "doc_id long, toxic int, quality int")))
    clean = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert clean.columns == columns
    score = net.score([t for _, t in rows])
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for (i, _), s in zip(rows, score) if s < 0.5)
    assert all(i is None or i >= 150 or i % 3 for i in (r["doc_id"] for r in clean.collect()))

    one = corpus_pipeline.without_near_copies(spark, docs, str(tmp_path))
    classes = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = one.collect()
    own = [classes[r["doc_id"], simhash.fingerprint(r["text"])] for r in kept]
    assert one.columns == columns and sorted(own) == sorted(set(classes.values()))
    assert all(r["doc_id"] == c for r, c in zip(kept, own))

    cut = corpus_pipeline.without_repeats(spark, docs, str(tmp_path))
    gone = slow_paragraphs(rows)
    assert cut.columns == columns and sum(passage in (r["text"] or "") for r in cut.collect()) == 1
    for r in cut.where("doc_id < 206").collect():
        lines = (dict(rows[:-4])[r["doc_id"]] or "").split("\n")
        assert (r["text"] or "") == "\n".join(x for k, x in enumerate(lines) if ((False, r["doc_id"]), k) not in gone)

    safe = corpus_pipeline.without_secrets(spark, docs, str(tmp_path))
    assert safe.columns == columns and safe.count() == len(rows)
    assert not any(s for r in secrets.scan(safe).collect() for s in r["spans"])
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(result[0].asDict()) and {5, 203} & {r["doc_id"] for r in result}


def test_pipeline_of_empty_tables(spark, tmp_path):
    frame(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """The values, not the names only, of columns that operators use themselves."""
    from pyspark.sql import functions as F

    own = {"score": "s", "spans": "t", "removed": "u", "n_removed": "v", "n_words_removed": "w", "predicted": "x", "kept_in": "y", "row": "z", "starts": "q"}
    docs = frame(spark).select("doc_id", "text", "n_chars", F.col("doc_id").alias("copy")).withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in own.items()})
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(26)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r["copy"] == r["doc_id"] and all(r[c] == (None if r["doc_id"] is None else f"{v}{r['doc_id']}") for c, v in own.items()), name
