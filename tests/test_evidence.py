"""Spans and segments of quotes against a character-by-character search."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from pressgrain.operators import evidence


def folded(text):
    """Folded text, with the raw offset of each character."""
    out = []
    for i, c in enumerate(text):
        if 0x300 <= ord(c) <= 0x36F:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not 0x300 <= ord(x) <= 0x36F).replace("ß", "ss")
        letters = re.sub("[^a-z0-9]", "", plain)
        out += [(x, i) for x in letters] or [(" ", i)]
    hay, at = "", []
    for c, i in out:
        if c != " " or (hay and not hay.endswith(" ")):
            hay += c
            at.append(i)
    return (hay[:-1], at[:-1]) if hay.endswith(" ") else (hay, at)


def test_spans_and_segments_equal_brute_force(spark):
    rng = random.Random(3)
    raw = ["Größe", "Ä", "straße", "éte", "ﬁn", "½", "x²", "12", "--", "…", "Wort", "wort", "😀"]
    texts, quotes = [], []
    for d in range(25):
        parts = [rng.choice(raw) + rng.choice([" ", ", ", "-", "", "\n"]) for _ in range(rng.randint(0, 60))]
        texts.append((d, "".join(parts)))
        for q in range(rng.randint(0, 5)):
            a = rng.randrange(len(parts) + 1)
            quotes.append((d, q, rng.choice([str.upper, str])("".join(parts[a : a + rng.randint(1, 4)]))))
    texts.append((99, ""))
    quotes += [(0, 90, ""), (0, 91, "zzzz"), (77, 1, "no text here"), (99, 1, "wort")]
    want = []
    for d, q, quote in quotes:
        hay, at = folded(dict(texts).get(d, ""))
        needle, _ = folded(quote)
        k = hay.find(needle) if len(needle) >= 4 else -1
        while k >= 0:
            want.append((d, q, at[k], at[k + len(needle) - 1] + 1))
            k = hay.find(needle, k + len(needle))
    t = spark.createDataFrame(texts, "doc_id long, text string")
    spans = evidence.evidence_spans(t, spark.createDataFrame(quotes, "doc_id long, quote_id long, quote string"))
    assert sorted(map(tuple, spans.select("doc_id", "quote_id", "start", "end").collect())) == sorted(want)
    pieces = []
    for d, text in texts:
        own = [x for x in want if x[0] == d]
        cuts = sorted({0, len(text), *(x[2] for x in own), *(x[3] for x in own)}) if own else []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces.append((d, k, a, b, sorted({x[1] for x in own if x[2] <= a and x[3] >= b})))
    got = evidence.segments(t, spans).select("doc_id", "segment", "start", "end", "quote_ids").collect()
    assert sorted((tuple(r[:4]), r[4]) for r in got) == sorted((x[:4], x[4]) for x in pieces)


def test_overlapping_and_similar_pairs_equal_brute_force(spark):
    from pyspark.sql import functions as F

    from pressgrain.functions import numbers as nb, text as tx
    from pressgrain.operators.evidence import overlapping_pairs, similar_pairs

    docs = spark.createDataFrame([(1, "Kundenerlebnis und Marke"), (2, "Apfel Birne Tomate"), (3, "Tomate Apfel abcd"), (4, None), (45, "")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, "Marke"), (77, "Kundenerlebnis"), (150, "Apfel, Tomate"), (199, "abcd"), (201, "")], "item_id long, claim string")
    every = docs.crossJoin(claims)
    want = {tuple(r) for r in every.where(nb.semantic_overlap(F.col("claim"), F.col("text"), ["und"])).select("doc_id", "item_id").collect()}
    got = [tuple(r) for r in overlapping_pairs(docs, claims, ["und"]).collect()]
    assert {(1, 77), (3, 150), (3, 199)} <= want and sorted(got) == sorted(want)
    heads = lambda c: tx.headline_tokens(tx.canonical_headline(F.col(c)))
    scored = every.select("doc_id", "item_id", tx.token_similarity(F.col("text"), F.col("claim")).alias("s")).where("s.shared > 0")
    pairs = similar_pairs(docs.select("doc_id", heads("text").alias("tokens")), claims.select("item_id", heads("claim").alias("tokens")))
    assert sorted((r["doc_id"], r["item_id"], r["shared"], r["score"]) for r in pairs.collect()) == sorted((r["doc_id"], r["item_id"], r["s"]["shared"], r["s"]["score"]) for r in scored.collect())


def test_evidence_spans_fold_each_text_once(spark):
    docs = spark.createDataFrame([(1, "Ä b C. Ä b C")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 7, "ä-b c!")], "doc_id long, quote_id long, quote string")
    found = evidence.evidence_spans(docs, quotes, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text#") == 1 and plan.count("split(quote#") == 1
    assert sorted((r["start"], r["end"]) for r in found.collect()) == [(0, 5), (7, 12)]


def test_spans_of_signs_marks_and_long_forms_equal_brute_force(spark):
    rng = random.Random(5)
    raw = ["\x01", "\x02", "\x03", "\u0301", "\u0301\u0308", "\u0130", "ẞ", "ß", "ﬃ", "Ǆ", "⒈", "½", "™", "K", "Ｗ", "😀", "\u212b", "\u00a0", "ab", "C", "d e", "f.", "^", "<"]
    texts = [(d, "".join(rng.choice(raw) + rng.choice(["", "", " ", "  ", ", "]) for _ in range(rng.choice([3, 40, 900])))) for d in range(30)]
    texts += [(50, "\u0301a b c d"), (51, " \u0301 abc d \u0301"), (52, "ß" * 600), (53, "...")]
    quotes = [(d, q, text[a : a + rng.randint(2, 12)]) for d, text in texts for q, a in enumerate(rng.randrange(len(text)) for _ in range(12))]
    want = []
    for d, q, quote in quotes:
        (hay, at), (needle, _) = folded(dict(texts)[d]), folded(quote)
        k = hay.find(needle) if len(needle) >= 2 else -1
        while k >= 0:
            want.append((d, q, at[k], at[k + len(needle) - 1] + 1))
            k = hay.find(needle, k + len(needle))
    found = evidence.evidence_spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "doc_id long, quote_id long, quote string"), 2)
    assert len(want) > 500 and sorted(map(tuple, found.collect())) == sorted(want)


def test_texts_are_not_taken_apart_into_characters(spark):
    docs = spark.createDataFrame([(1, "Ä b C")], "doc_id long, text string")
    found = evidence.evidence_spans(docs, docs.select("doc_id", F.lit(1).alias("quote_id"), F.col("text").alias("quote")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"split\((?:text|quote)#\d+, ,", plan)


def test_segments_compute_the_spans_once(spark):
    docs = spark.createDataFrame([(1, "ab cd ef gh ij"), (1, "ab cd"), (2, "zz"), (None, "ab cd")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, 5, "ab cd"), (1, 6, "cd ef gh"), (1, None, "ef gh ij"), (2, 7, "nothing"), (None, 8, "ab cd")], "doc_id long, quote_id long, quote string")
    found = evidence.segments(docs, evidence.evidence_spans(docs, quotes))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    cuts = [(0, 3, [5]), (3, 5, [5, 6]), (5, 6, [6]), (6, 11, [6]), (11, 14, [])]
    assert sorted(map(tuple, found.collect())) == [(1, k, *x) for k, x in enumerate(cuts)]


def test_borders_are_numbered_alike_wherever_the_parts_were_dealt(spark):
    texts = [(d, "x. " * (d % 3) + "some words here. " + "more of them, " * (d % 5 + 1)) for d in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8, "doc_id")
    quotes = docs.select("doc_id", F.posexplode(F.array(F.lit("words here"), F.lit("here more"), F.lit("them"))).alias("quote_id", "quote"))
    spans = evidence.evidence_spans(docs, quotes)
    own, want = {}, []
    for d, q, a, b in map(tuple, spans.collect()):
        own.setdefault(d, []).append((q, a, b))
    for d, text in texts:
        cuts = sorted({0, len(text), *(x for s in own[d] for x in s[1:])})
        want += [(d, k, a, b, sorted({q for q, x, y in own[d] if x <= a and y >= b})) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:4]), r[4]) for r in evidence.segments(docs, spans).collect()) == [(x[:4], x[4]) for x in sorted(want)]
