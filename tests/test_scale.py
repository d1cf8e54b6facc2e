"""Skew-safe operators against the plain form, on data where one key holds most rows."""

import itertools
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressgrain.functions.text import evidence_skeleton
from pressgrain.operators import dedup, entities, evidence, joins
from pressgrain.operators.windows import islands
from pressgrain.scale import exact_percentiles, neighbour, running_sum, spread


def hot(spark, n=3000):
    rnd = random.Random(5)
    rows = [(1 if rnd.random() < 0.7 else rnd.randrange(2, 9), rnd.randrange(0, 5000), i, rnd.choice("ab"), rnd.random() * 50) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, id int, state string, v double")


def test_neighbour_matches_window(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    bucket = F.floor(F.col("t") / 37)
    for forward, plain in ((True, F.lead("id").over(w)), (False, F.lag("id").over(w))):
        got = neighbour(df, ["k"], ["t", "id"], bucket, ["id"], "n", forward).select("id", F.col("n.id").alias("x"))
        want = df.select("id", plain.alias("x"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_running_sum_and_islands_match_window(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    bucket = F.floor(F.col("t") / 91)
    got = running_sum(df, ["k"], ["t", "id"], bucket, "t", "s").select("id", "s")
    assert set(map(tuple, got.collect())) == set(map(tuple, df.select("id", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()))
    plain = df.withColumn("c", (~F.lag("state").over(w).eqNullSafe(F.col("state"))).cast("int")).select("id", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("i"))
    got = islands(df, ["k"], ["t", "id"], bucket, "state").select("id", F.col("island").alias("i"))
    assert set(map(tuple, got.collect())) == set(map(tuple, plain.collect()))


def test_percentiles_are_exact(spark):
    df = hot(spark)
    got = {(r["k"], r["prob"]): r["value"] for r in exact_percentiles(df, ["k"], "v", [0.1, 0.5, 0.75], 0.9).collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", p).alias(str(p)) for p in (0.1, 0.5, 0.75)]).collect()
    for r in want:
        for p in (0.1, 0.5, 0.75):
            assert abs(got[(r["k"], p)] - r[str(p)]) < 1e-9


def test_percentiles_with_tied_values(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [5, 5, 5, 7, 9, 9]], "k int, v double")
    got = {r["prob"]: r["value"] for r in exact_percentiles(df, ["k"], "v", [0.0, 0.5, 0.75, 1.0], 2.0).collect()}
    assert got == {0.0: 5.0, 0.5: 6.0, 0.75: 8.5, 1.0: 9.0}


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i:03d}" for i in range(60)]
    docs = []
    for i in range(250):
        base = rnd.sample(vocab, rnd.randrange(3, 9)) if i < 80 or rnd.random() < 0.2 else list(docs[rnd.randrange(len(docs))][1])
        if rnd.random() < 0.5 and len(base) > 3:
            base[rnd.randrange(len(base))] = rnd.choice(vocab)
        docs.append((i, sorted(set(base))))
    # A third of all rows are copies of one document.
    docs += [(1000 + j, docs[0][1]) for j in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["duplicate_of"] for r in dedup.near_duplicates(df, 0.6, 3).collect()}
    reps = {}
    for i, tk in docs:
        reps.setdefault(tuple(tk), i)
    best = {}
    for (ta, a), (tb, b) in itertools.combinations(reps.items(), 2):
        sa, sb = set(ta), set(tb)
        if len(sa & sb) >= 3 and len(sa & sb) / len(sa | sb) >= 0.6:
            best[max(a, b)] = min(best.get(max(a, b), 10**9), min(a, b))
    want = {}
    for i, tk in docs:
        rep = reps[tuple(tk)]
        target = min(rep, best.get(rep, rep))
        if target != i:
            want[i] = target
    assert got == want


def test_quotes_match_brute_force(spark):
    rnd = random.Random(9)
    words = ["markt", "kunde", "größe", "preis", "neu", "studie", "ergebnis", "team", "und", "der"]
    docs = [(i, " ".join(rnd.choices(words, k=60))) for i in range(60)]
    quotes = [(j, docs[j % 60][1][(j * 7) % 90: (j * 7) % 90 + 10 + j]) for j in range(50)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    got = {(r["doc_id"], r["item_id"]) for r in evidence.quotes_in_documents(d, q).collect()}
    sk_d = {r["doc_id"]: r["s"] for r in d.select("doc_id", evidence_skeleton(F.col("text")).alias("s")).collect()}
    sk_q = {r["item_id"]: r["s"] for r in q.select("item_id", evidence_skeleton(F.col("quote")).alias("s")).collect()}
    want = {(i, j) for i, a in sk_d.items() for j, b in sk_q.items() if len(b) >= 12 and b in a}
    assert got == want and want


def test_near_duplicates_by_one_shared_token_and_sets_that_share_a_rare_one(spark):
    rnd = random.Random(10)
    docs = [(i, sorted(set(rnd.choices([f"w{k}" for k in range(25)], k=rnd.randrange(1, 6))))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    reps = {}
    for i, tk in docs:
        reps.setdefault(tuple(tk), i)
    for score, least in ((0.3, 1), (0.5, 2), (1.0, 1)):
        got = {r["doc_id"]: r["duplicate_of"] for r in dedup.near_duplicates(df, score, least).collect()}
        near = lambda a, b: len(set(a) & set(b)) >= least and len(set(a) & set(b)) / len(set(a) | set(b)) >= score
        to = {i: min([rep for tk, rep in reps.items() if rep <= reps[tuple(own)] and (rep == reps[tuple(own)] or near(tk, own))]) for i, own in docs}
        assert got == {i: d for i, d in to.items() if i != d}
    # 400 sets share one of their rarest tokens and nothing else; no join makes a row per pair.
    df = spark.range(400).selectExpr("id as doc_id", "concat(array('shared'), transform(sequence(1, 5), k -> concat('t', pmod(xxhash64(id, k), 90)))) as tokens")
    plan = dedup.near_duplicates(df.selectExpr("doc_id", "array_distinct(tokens) as tokens"), 0.6, 3)
    plan.collect()
    assert 0 < rows_made(plan) <= 20_000


def test_aliases_match_brute_force(spark):
    texts = [(1, "Die Muster AG wächst, sagt Muster."), (2, "Ein Musterhaus"), (3, "muster ag und Beispiel Gruppe"), (4, "")]
    alias = [("m", "Muster AG"), ("m", "Muster"), ("b", "Beispiel Gruppe"), ("x", "AG")]
    hits = entities.match_aliases(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(alias, "company string, alias string"))
    assert {tuple(r) for r in hits.collect()} == {(1, "m", "muster ag"), (1, "m", "muster"), (3, "m", "muster ag"), (3, "m", "muster"), (3, "b", "beispiel gruppe")}


def test_aliases_in_both_forms_and_candidates_that_share_a_long_word(spark):
    rnd = random.Random(9)
    pool = ["aa", "bbb", "cc", "ddd", "ee", "sameword"]
    texts = [(i, " ".join(rnd.choices(pool, k=rnd.randrange(0, 40)))) for i in range(60)]
    alias = [(j, " ".join(rnd.choices(pool, k=rnd.randrange(1, 6)))) for j in range(60)]
    d, a = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(alias, "company long, alias string")
    want = sorted((i, j, x) for i, t in texts for j, x in alias if len(x) >= 3 and f" {x} " in f" {t} ")
    for most in (500_000, 0):
        assert sorted(tuple(r) for r in entities.match_aliases(d, a, most_aliases=most).collect()) == want
    # 300 texts and 300 aliases share their longest word; no join makes a row per pair.
    d = spark.range(300).selectExpr("id as doc_id", "concat('p', id, ' thelongestword q') as text")
    plan = entities.match_aliases(d, spark.range(300).selectExpr("id as company", "concat('p', id, ' thelongestword') as alias"))
    assert sorted((r["doc_id"], r["company"]) for r in plan.collect()) == [(i, i) for i in range(300)]
    assert 300 <= rows_made(plan) <= 5_000


def test_aliases_with_the_same_beginning_meet_texts_by_their_rarest_pair(spark):
    d = spark.range(300).selectExpr("id as doc_id", "concat('one of the p', id, ' end') as text")
    alias = spark.range(300).selectExpr("id as company", "concat('of the p', id) as alias")
    for most in (500_000, 0):
        assert sorted((r["doc_id"], r["company"]) for r in entities.match_aliases(d, alias, most_aliases=most).collect()) == [(i, i) for i in range(300)]
    # What is left to be compared, if all of it is taken.
    assert entities.match_aliases(d, alias, holds=lambda n, a: F.lit(True)).count() == 300


def test_single_word_names_need_context(spark):
    texts = [(1, "Die Marke Tempo wächst"), (2, "Das Tempo steigt"), (3, "Tempo investiert in Werke"), (4, "Neues bei Tempo mit mehr Umsatz")]
    alias = spark.createDataFrame([("t", "Tempo")], "company string, alias string")
    hits = entities.match_companies(spark.createDataFrame(texts, "doc_id long, text string"), alias)
    assert {r["doc_id"] for r in hits.collect()} == {1, 3, 4}


def test_company_key_prefixes(spark):
    left = spark.createDataFrame([(1, "muster"), (2, "ab"), (3, "beispielhaus")], "a int, k string")
    right = spark.createDataFrame([(10, "musterlogo"), (11, "muster"), (12, "beispiel"), (13, "abc")], "b int, k string")
    got = {(r["a"], r["b"], r["exact"]) for r in entities.company_key_match(left, right, "k").collect()}
    assert got == {(1, 10, False), (1, 11, True), (3, 12, False)}


def test_asof_run_matches_brute_force(spark):
    rnd = random.Random(2)
    t0 = 1_700_000_000
    runs = [(i, "v" if rnd.random() < 0.8 else "w", t0 + rnd.randrange(200_000), rnd.choice([None, 600, 9_000, 90_000])) for i in range(120)]
    runs = [(i, k, s, None if d is None else s + d) for i, k, s, d in runs]
    events = [(i, rnd.choice("vw"), t0 + rnd.randrange(220_000)) for i in range(400)]
    as_of = t0 + 210_000
    r = spark.createDataFrame(runs, "run_id long, ver string, s long, e long").selectExpr("run_id", "ver", "timestamp_seconds(s) as started_at", "timestamp_seconds(e) as finished_at")
    e = spark.createDataFrame(events, "event_id long, ver string, s long").selectExpr("event_id", "ver", "timestamp_seconds(s) as created_at")
    got = {x["event_id"]: x["run_id"] for x in joins.asof_run(e, r, "ver", F.timestamp_seconds(F.lit(as_of))).collect()}
    for i, k, at in events:
        fit = [(s, rid) for rid, rk, s, end in runs if rk == k and s <= at <= (as_of if end is None else end)]
        assert got[i] == (max(fit)[1] if fit else None)


def test_spread_only_touches_narrow_inputs(spark):
    wide, narrow = spark.range(0, 1000, 1, 16), spark.range(0, 1000, 1, 1)
    assert spread(wide, "id").rdd.getNumPartitions() == 16
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_plans_avoid_cross_joins_of_tables(spark):
    """No registered plan may hold a nested-loop join other than with a one-row aggregate or a broadcast of checked size."""
    import contextlib
    import io

    import __spark_entry__ as entry

    for name in ("d10_match_rules", "d11_match_aliases", "d12_near_duplicates", "d08_asof_run", "c01_prefilter", "c22_match_companies", "b20_company_key_match"):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            entry.queries()[name](spark, "/root/testdata/sf0.001").explain("formatted")
        assert "CartesianProduct" not in buf.getvalue() and "NestedLoopJoin" not in buf.getvalue(), name


def test_offering_rank_is_the_same_in_one_shard_and_in_many(spark):
    from pressgrain.operators.catalogue import rank_offerings

    arts = spark.createDataFrame([(1, "Die Markenstrategie braucht Positionierung und Kundenerlebnis", ["f"]), (2, "Ganz anderes Thema ohne Bezug", ["g"]), (3, "Kundenerlebnis und Touchpoints steuern", [])],
                                 "doc_id long, text string, families array<string>")
    offers = spark.createDataFrame([("a", 1, "Markenstrategie", "Positionierung schärfen"), ("b", 2, "Kundenerlebnis", "Touchpoints steuern"), ("c", 3, "Audit", "Prozesse prüfen")],
                                   "offering_id string, position int, label string, description string")
    pref = {"f": ["c", "a"], "g": ["b", "c", "b"]}
    small = rank_offerings(arts, offers, pref, 2)
    large = rank_offerings(arts, offers, pref, 2, shard_words=1)
    want = {(1, 1, "a", 109), (1, 2, "b", 65), (2, 1, "c", 39), (2, 2, "b", 38), (3, 1, "b", 75)}
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} == want


def test_offering_ties_are_broken_by_id(spark):
    from pressgrain.operators.catalogue import rank_offerings

    arts = spark.createDataFrame([(1, "Markenstrategie", [])], "doc_id long, text string, families array<string>")
    offers = spark.createDataFrame([(x, 1, "Markenstrategie", "") for x in "dbeac"], "offering_id string, position int, label string, description string")
    for limit in (500, 7):
        got = rank_offerings(arts, offers, {"f": ["a"]}, 3, shard_words=limit)
        assert [r["offering_id"] for r in got.orderBy("rank").collect()] == ["a", "b", "c"]
        assert "collect_list" not in got._jdf.queryExecution().toString()


def _slow_rank(texts, entries, k, least):
    out = []
    for doc, text, wanted in texts:
        scored = []
        for name, position, label, own in entries:
            last = max((i for i, w in enumerate(wanted) if w == name), default=None)
            score = 5 * min(8, len({w for w in text.split(" ")} & set(own))) + (60 if len(label) >= 6 and label in text else 0)
            score += 0 if last is None else max(20, 40 - last)
            if score >= least:
                scored.append((-score, position, name))
        out += [(doc, r + 1, name, -s) for r, (s, _, name) in enumerate(sorted(scored)[:k])]
    return out


def test_top_entries_equal_all_pairs(spark):
    import random

    from pressgrain.operators.retrieval import top_entries

    for seed, vocabulary, shard in ((1, 30, 10_000), (2, 200, 90), (3, 12, 400)):
        rng = random.Random(seed)
        words = [f"word{i:03d}" for i in range(vocabulary)]
        entries = [(f"e{i}", rng.randrange(5), rng.choice(words) + rng.choice(["", " " + rng.choice(words)]), sorted({rng.choice(words) for _ in range(rng.randint(0, 14))})) for i in range(150)]
        texts = [(d, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60]))), [f"e{rng.randrange(200)}" for _ in range(rng.choice([0, 0, 1, 30]))]) for d in range(60)]
        cat = spark.createDataFrame(entries, "offering_id string, position int, label string, words array<string>")
        rows = spark.createDataFrame(texts, "doc_id long, n string, wanted array<string>")
        got = top_entries(rows, cat, 4, 10, shard, 16)
        assert sorted(map(tuple, got.collect())) == sorted(_slow_rank(texts, entries, 4, 10))
    assert top_entries(rows, cat.limit(0), 4, 10).count() == 0


def test_a_catalogue_of_fifty_thousand(spark):
    """Chunks that cannot beat the best entries are skipped, and no row per document and offering is made."""
    import time

    from pyspark.sql import functions as F

    from pressgrain.operators.retrieval import top_entries

    own = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", x), F.lit(20_000)).cast("string")))
    cat = spark.range(50_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("offering_id"), F.col("id").alias("position"), F.concat(F.lit("label "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("label"), F.array_distinct(own).alias("words"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.concat(F.lit("word"), F.pmod(F.xxhash64("id", x + 77), F.lit(20_000)).cast("string"))), " ")
    texts = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(" label "), F.lpad((F.col("id") * 20 + 9_000).cast("string"), 6, "0")).alias("n"), F.array().cast("array<string>").alias("wanted"))
    began = time.time()
    got = top_entries(texts, cat, 3, 10).collect()
    assert time.time() - began < 60
    assert len(got) == 6_000
    assert all(r["score"] >= 60 and r["offering_id"] == f"o{r['doc_id'] * 20 + 9_000}" for r in got if r["rank"] == 1)
    entries = {r["offering_id"]: (r["position"], set(r["words"])) for r in cat.collect()}
    for d in texts.where("doc_id in (0, 777, 1999)").collect():
        mine = set(d["n"].split(" "))
        scored = sorted((-(5 * min(8, len(mine & w)) + (60 if f"label {p:06d}" in d["n"] else 0)), p) for p, w in entries.values())[:3]
        assert [(-r["score"], entries[r["offering_id"]][0]) for r in sorted(got, key=lambda r: r["rank"]) if r["doc_id"] == d["doc_id"]] == scored


def test_a_kept_pool_gives_the_forecast_of_all_runs(spark):
    """Batches in any order, late runs and repeated batches; at most two scans of the pool's tables."""
    import random

    from pressgrain.operators import runs as rn
    from pressgrain.operators.dedup import written

    rng = random.Random(3)
    runs = [(i, rng.choice(["memo", "post"]), rng.choice(["done", "done", "error"]), rng.choice(["a", "b", None]), f"2024-01-{rng.randint(1, 28):02d}", rng.choice([5_000, 9_000, 40_000, 70_123]), rng.randrange(9_000)) for i in range(300)]
    logs = [(r[0], i * 1_000 + r[0], rng.choice(["stage", "stage", "image_start", "images_done"]), rng.choice(rn.STAGES), rng.randrange(9_000)) for r in runs for i in range(rng.choice([0, 3, 9]))]
    rows = spark.createDataFrame(runs, "run_id long, kind string, status string, images string, created_at string, duration_ms long, total_tokens long")
    log = spark.createDataFrame(logs, "run_id long, event_id long, event string, stage string, t long")
    pool = None
    for batch in (2, 0, 1, 0):
        pool = written(rn.merge_pool(pool, rows.where(f"run_id % 3 = {batch}"), log, ["images"], 6), "pool")
    for kind in ("memo", "post", "none"):
        for params in ({}, {"images": "a"}, {"images": None}, {"images": "zz"}):
            kept = rn.forecast_of_pool(pool, kind, params, 6)
            assert kept.collect() == rn.duration_forecast(rows, log, kind, params, 6).collect()
            assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_asof_run_inside_one_slice_and_work_that_grows_with_the_rows(spark):
    rnd = random.Random(8)
    runs = [(i, "v", s, s + rnd.choice([0, 1, 7, 500, 4_000, 9_000_000])) for i, s in enumerate(rnd.randrange(20_000) for _ in range(150))]
    events = [(i, "v", rnd.randrange(22_000)) for i in range(300)] + [(300, None, 5), (301, "v", None)]
    at = "timestamp_micros(1700000000000000 + {})".format
    r = spark.createDataFrame(runs, "run_id long, ver string, s long, e long").selectExpr("run_id", "ver", at("s") + " as started_at", at("e") + " as finished_at")
    e = spark.createDataFrame(events, "event_id long, ver string, s long").selectExpr("event_id", "ver", at("s") + " as created_at")
    got = {x["event_id"]: x["run_id"] for x in joins.asof_run(e, r, "ver", F.lit(None).cast("timestamp")).collect()}
    for i, k, t in events:
        fit = [(s, rid) for rid, rk, s, end in runs if rk == k and t is not None and s <= t <= end]
        assert got[i] == (max(fit)[1] if fit else None)
    # 3,000 events and 3,000 runs in one slice of one key: no join makes a row per pair.
    many = spark.range(3_000).selectExpr("id", "'v' as ver", at("id * 1000") + " as t")
    runs = many.selectExpr("id as run_id", "ver", "t as started_at", "t + interval 6 hours as finished_at")
    plan = joins.asof_run(many.selectExpr("id as event_id", "ver", "t as created_at"), runs, "ver", F.lit(None).cast("timestamp"))
    assert sorted((x["event_id"], x["run_id"]) for x in plan.collect()) == [(i, i) for i in range(3_000)]
    assert 3_000 <= rows_made(plan) <= 20_000


def rows_made(df):
    """The most rows that an operator of the executed plan put out."""
    found = []

    def walk(node):
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        found.append(metric.get().value() if metric.isDefined() else 0)

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)
