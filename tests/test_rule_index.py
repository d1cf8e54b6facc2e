"""Rules as a table against trying every rule on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pressgrain.functions.text import norm_literal
from pressgrain.operators.rule_index import _tested, keys_of, match_rule_table, within_word


@pytest.mark.parametrize(
    "pattern,keys",
    [
        (r"\b(the|der)\b", ["=der", "=the"]),
        (r"\b(marke\w*|brand)\b", ["=brand", "~mark"]),
        (r"\bprivate label\w*", ["=private"]),
        (r"\b(?:white ?paper|playbook)\b", ["=playbook", "~whit"]),
        (r"^(?:event )?(?:agenda|tickets)(?: \d{4})?$", ["~gend", "~icke"]),
        (r"jetzt .*abo|lesen", ["~jetz", "~lese"]),
        (r"\b\d+ (?:the|de)\b", ["=de", "=the"]),
        (r"colou?r", ["~colo"]),
        (r"ab{2,3}cdef", ["~cdef"]),
        (r"a|bcde", None), (r"x*", None), (r"(?=the)", None), (r"(?i)the", None), (r"[a-z]+", None), (r"(un", None), (r"\1", None), (None, None),
    ],
)
def test_keys(pattern, keys):
    assert keys_of(pattern) == keys


def brute(texts, rules):
    out = set()
    for i, text, title in texts:
        n, t = norm_literal(text or ""), norm_literal(title or "")
        for rule, trigger, context, exclude in rules:
            if trigger and re.search(trigger, n) and (not context or re.search(context, n)) and not (exclude and re.search(exclude, t)):
                out.add((i, rule))
    return out


def made(rng, words):
    w = [rng.choice(words) for _ in range(4)]
    return rng.choice([rf"\b({w[0]}|{w[1]})\b", rf"\b{w[0][:5]}\w*", rf"\b{w[0]} {w[1]}\b", rf"{w[0][1:]}.*{w[2]}", rf"\b(?:{w[0]}|{w[1][:4]}\w*) ?{w[2]}s?\b", rf"{w[3][:2]}[aeiou]\w+ {w[1]}", rf"(?:{w[0]}|{w[1]}|{w[2]})(?: {w[3]})?"])


def test_ten_thousand_rules_of_a_table(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(3_000)]
    rules = [(i, made(rng, words), made(rng, words) if i % 3 == 0 else None, rf"\b{rng.choice(words)}" if i % 5 == 0 else None) for i in range(10_000)]
    rules += [(20_000, r"^$", None, None), (20_001, r"\d{3}", None, None), (20_002, None, "x", None), (20_003, r"(?i)ABD", None, None), (5, rules[5][1], rules[5][2], rules[5][3])]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 10, 60]))), rng.choice(words)) for i in range(60)]
    texts += [(100, None, None), (101, "", ""), (102, "Größe 123 " + words[0].upper() + "!", "t"), (103, texts[3][1] * 50, "x"), (3, texts[3][1], texts[3][2])]
    spark.createDataFrame(rules, "rule_id long, trigger string, context string, exclude_title string").write.parquet(str(tmp_path / "rules"))
    df = spark.createDataFrame(texts, "doc_id long, text string, title string")
    got = match_rule_table(df, spark.read.parquet(str(tmp_path / "rules")), "doc_id", "text", "title", 100)
    pairs = [tuple(r) for r in got.collect()]
    plain = {(i, r) for i, r in brute(texts, [(a, b.replace("(?i)ABD", "abd") if b else b, c, d) for a, b, c, d in rules])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain and len(plain) > 1_000
    assert match_rule_table(df.limit(0), spark.read.parquet(str(tmp_path / "rules")), "doc_id", "text").count() == 0
    assert match_rule_table(df, spark.createDataFrame([], "rule_id long, trigger string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "pattern,inside",
    [
        (r"\b(the|der)\b", True), (r"th[aeiou]+n", True), (r"\bmark\w*", True), (r"ab{2,3}c\d?", True), ("Ab", True),
        (r"\b(the |der)", False), (r"a.c", False), (r"^the", False), (r"the$", False), (r"x*", False), (r"(a|)", False), (r"[^a]b", False),
        (r"a\sb", False), (r"(?i)the", False), (r"(?=the)", False), (r"[ -z]b", False), (r"(a)\1", False), (r"(un", False), (None, False),
    ],
)
def test_patterns_that_stay_within_a_word(pattern, inside):
    assert within_word(pattern) == inside


def test_rows_of_one_key_are_tested_apart(spark):
    df = spark.createDataFrame([(1, "alpha"), (1, "beta"), (None, "alpha beta"), (2, "")], "doc_id long, text string")
    rules = spark.createDataFrame([(7, r"\balpha\b", r"\bbeta\b"), (7, r"ga+m", None), (8, r"\b[ab]\w+", "a b")], "rule_id long, trigger string, context string")
    assert {tuple(r) for r in match_rule_table(df, rules, "doc_id", "text").collect()} == {(None, 7), (None, 8)}


def test_texts_are_searched_only_for_patterns_across_words(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    rules = spark.createDataFrame([(7, r"\balpha\b", r"b[aeiou]t"), (8, r"a b", None)], "rule_id long, trigger string, context string")
    pack = next(_tested(iter([rules.withColumn("exclude_title", F.lit(None).cast("string")).toPandas()])))
    assert list(map(list, pack["exact"])) == [[0], []] and [len(x) for x in pack["tests"]] == [1, 0]
    assert {tuple(r) for r in match_rule_table(df, rules, "doc_id", "text").collect()} == {(1, 7), (1, 8)}
