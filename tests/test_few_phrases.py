"""Few aliases and quotes are tried on each text as they are; the result is that of the joins on keys and grams."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pressgrain.functions.text import sentences
from pressgrain.operators.entities import match_aliases, match_companies
from pressgrain.operators.evidence import contained_pairs
from tests.helpers import evaluate


def made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_aliases(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "abcd", "Ärzte", "in", "group", "x"]
    texts = spark.createDataFrame([(i, made(rng, words, rng.choice([0, 1, 5, 30]))) for i in range(80)] + [(90, None)], "doc_id long, text string")
    aliases = spark.createDataFrame([(f"c{i % 7}", made(rng, words, rng.randint(1, 3))) for i in range(40)] + [("d", None), ("e", "")], "company string, alias string")
    for find in (match_aliases, lambda *a, few: match_aliases(*a, most_aliases=0, few=few)):
        got = [sorted(tuple(r) for r in find(texts, aliases, few=few).collect()) for few in (256, 0)]
        assert got[0] == got[1] and len(got[0]) > 100 and len(set(got[0])) == len(got[0])
    assert "zip_with" not in match_companies(texts, aliases)._jdf.queryExecution().analyzed().toString()
    assert match_aliases(texts, aliases.limit(0)).count() == 0


def test_quotes(spark):
    rng = random.Random(4)
    hays = spark.createDataFrame([(i, "".join(rng.choice("abc ") for _ in range(60))) for i in range(50)] + [(60, None), (61, "")], "doc_id long, hay string")
    needles = spark.createDataFrame([(i % 9, "".join(rng.choice("abc ") for _ in range(rng.randint(2, 6)))) for i in range(60)] + [(70, None)], "item_id long, needle string")
    got = [sorted({tuple(r) for r in contained_pairs(hays, needles, 4, few=few).collect()}) for few in (2_000, 0)]
    assert got[0] == got[1] and len(got[0]) > 50
    assert contained_pairs(hays, needles.limit(0), 4).count() == 0


def test_sentences_are_cut_at_blanks_after_their_end(spark):
    texts = ["One. Two!  Three?\n\nFour\nfive.Six\t. Seven", "a. b. c", " .\n x", ""]
    plain = evaluate(spark, texts, lambda c: F.array_join(F.split(c, r"(?<=[.!?])\s+|\n+"), "|"))
    found = evaluate(spark, texts, lambda c: F.array_join(F.transform(sentences(c, 0), lambda s: s), "|"))
    assert found == ["|".join(p.strip(" \t\n") for p in x.split("|")) for x in plain]


def test_lead_numbers_use_all_cores(spark):
    df = entry.queries()["b31_lead_numbers"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
