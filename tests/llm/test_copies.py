"""Near copies of documents and repeated passages, against brute force."""

import random
import zlib

import numpy as np

import corpus_pipeline
from pressgrain.llm import copies, paragraphs, passages, simhash
from tests.llm.fixtures import frame, words
from tests.llm.test_tables import Union, slow_paragraphs


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(a & b) / len(a | b)


def test_near_copies_equal_brute_force(spark, tmp_path):
    rng = random.Random(31)
    rows = []
    for k in range(40):
        base = words(rng, 120).split(" ")
        for copy in range(3):
            own = list(base)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
                own[at] = f"new{rng.randrange(10**6)}"
            rows.append((3 * k + copy, " ".join(own)))
    rows += [(500, rows[0][1].upper()), (501, None), (502, " \n"), (503, words(rng, 3)), (504, words(rng, 30))]
    own = Union()
    for i, a in rows:
        own.root(i)
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                own.join(i, j)
    want = {i: own.root(i) for i, _ in rows}
    for chunk_rows in (2_000, 2):
        got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(frame(spark, rows), chunk_rows=chunk_rows).collect()}
        assert got == want
    kept = corpus_pipeline.without_near_copies(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert copies.near_copies(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_link_what_the_fingerprints_link(spark):
    """Pairs that share no MinHash band, but lie within the radius of their fingerprints."""
    rng = random.Random(35)
    rows, pairs = [], 0
    while pairs < 3:
        a = words(rng, 100).split(" ")
        b = list(a)
        for at in rng.sample(range(100), 5):
            b[at] = f"new{rng.randrange(10**6)}"
        keys = paragraphs.band_keys(*paragraphs.shingles(*paragraphs._hashes([a, b])))
        apart = (simhash.fingerprint(" ".join(a), 5) ^ simhash.fingerprint(" ".join(b), 5)) & (2**64 - 1)
        if (keys[0] != keys[1]).all() and apart.bit_count() <= 16 and jaccard(" ".join(a), " ".join(b)) >= 0.5:
            rows += [(2 * pairs, " ".join(a)), (2 * pairs + 1, " ".join(b))]
            pairs += 1
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(frame(spark, rows), 0.5, radius=16).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}


def repeated_runs(texts, least=50):
    """Word numbers (text, word) at which a run starts that stands earlier too."""
    seen, out = set(), set()
    for k, t in enumerate(texts):
        own = (t or "").split()
        for i in range(len(own) - least + 1):
            run = tuple(own[i : i + least])
            if run in seen:
                out.add((k, i))
            seen.add(run)
    return out


def test_passages_equal_brute_force(spark, tmp_path):
    rng = random.Random(32)
    passage = words(rng, 60).split(" ")
    rows = [(i, f"{words(rng, 40)} {' '.join(passage)} {words(rng, 10)}") for i in range(4)]  # in one long line each
    rows += [(10 + i, "\n".join([words(rng, 15), *(" ".join(passage[k : k + 7 + i]) for k in range(0, 60, 7 + i)), words(rng, 9)])) for i in range(3)]  # wrapped
    pool = words(rng, 400).split(" ")
    for k in range(30):
        a = rng.randrange(330)
        rows.append((20 + k, f"{words(rng, 5)}  {' '.join(pool[a : a + rng.randint(30, 120)])}\n\n{words(rng, 8)}"))
    rows += [(60, "again " * 200), (61, None), (62, ""), (63, words(rng, 49)), (64, words(rng, 50))]
    want = []
    found = repeated_runs([t for _, t in rows])
    for k, (i, t) in enumerate(rows):
        own = (t or "").split()
        gone = {j for n, s in found if n == k for j in range(s, s + 50)}
        want.append((i, [w for j, w in enumerate(own) if j not in gone], len(gone)))
    got = passages.remove_passages(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], (r["text"] or "").split(), r["n_words_removed"]) for r in got) == sorted(want)
    assert {r["doc_id"] for r in got if r["text"] is None} == {61}
    stage = corpus_pipeline.without_repeats(spark, frame(spark, rows), str(tmp_path)).orderBy("doc_id").collect()
    assert not repeated_runs([r["text"] for r in stage]) and sum(" ".join(passage) in " ".join((r["text"] or "").split()) for r in stage) == 1
    assert passages.remove_passages(frame(spark, rows).limit(0)).count() == 0


def test_repeated_text_equals_brute_force_in_two_steps(spark):
    """Paragraphs first, near copies too, then runs of 50 words inside longer lines and across short ones."""
    rng = random.Random(34)
    passage, line = words(rng, 60).split(" "), words(rng, 40).split(" ")
    rows = [(i, f"{words(rng, 30)}\n{words(rng, 40)} {' '.join(passage)} {words(rng, 10)}") for i in range(4)]
    rows += [(10 + i, "\n".join([words(rng, 15), *(" ".join(passage[k : k + 7 + i]) for k in range(0, 60, 7 + i)), words(rng, 9)])) for i in range(3)]
    for i in range(5):
        near = [*line]
        near[-1] = f"changed{i}"
        rows.append((20 + i, f"{words(rng, 25)}\n{' '.join(near)}"))
    rows += [(30 + i, words(rng, 120)) for i in range(5)] + [(40, None), (41, ""), (None, rows[0][1])]
    gone = slow_paragraphs(rows)
    left = []
    for i, t in rows:
        own = (i is None, i or 0)
        left.append((i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if (own, k) not in gone)))
    runs = repeated_runs([t for _, t in left])
    want = {}
    for k, (i, t) in enumerate(left):
        cut = {j for n, at in runs if n == k for j in range(at, at + 50)}
        want[i] = ([w for j, w in enumerate((t or "").split()) if j not in cut], len(cut))
    got = passages.remove_repeated_text(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: ((r["text"] or "").split(), r["n_words_removed"]) for r in got} == want
    assert {r["doc_id"] for r in got if r["n_words_removed"]} == {1, 2, 3, 10, 11, 12} and {r["doc_id"] for r in got if r["n_removed"]} == {21, 22, 23, 24, None}
    assert all(want[i] == ((t or "").split(), 0) for i, t in rows if i in (30, 31, 32, 33, 34, 40, 41))
    assert passages.remove_repeated_text(frame(spark, rows).limit(0)).count() == 0


def test_pipeline_packs_token_ids(spark, tmp_path):
    rng = random.Random(33)
    docs = frame(spark, [(i, words(rng, rng.choice([20, 300, 1500]))) for i in range(30)])
    got = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert got and all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
