"""Normalising is most of the work on long texts: plans hold it once per text, and the shorter ways give the plain results."""

import pytest
from pyspark.sql import functions as F

from pressgrain.functions import numbers as nm, text as tx
from pressgrain.operators import quality as ql
from pressgrain.rules.packs import FIXTURE
from tests.helpers import evaluate


def foldings(spark, col):
    plan = spark.createDataFrame([("a", "b")], "title string, text string").select(col.alias("x"))
    return plan._jdf.queryExecution().analyzed().toString().count("ß, ss")


def test_cleaning_passages_and_paywall_fold_a_text_once(spark):
    assert foldings(spark, tx.clean_article_text(F.col("text"))) == 1
    assert foldings(spark, tx.select_passages(F.col("text"), 1500)) == 1
    assert foldings(spark, ql.text_quality(F.col("text"))) == 1


def test_all_rejections_fold_title_and_text_once(spark):
    assert foldings(spark, ql.hard_rejections(F.col("title"), F.col("text"), FIXTURE, 2026)) == 2


def test_stems_fold_a_text_once(spark):
    assert foldings(spark, nm.semantic_tokens(F.col("text"), [])) == 1


def test_runs_between_words(spark):
    texts = ["a b", "a  b", "a, b", "a,b", " a ", "\ta b\n", "ÄÖ ½ ﬁn…", "日 a", "", "ΟΔΟΣ İ"]
    plain = [" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x).split()) for x in evaluate(spark, texts, tx.fold)]
    assert evaluate(spark, texts, tx.norm_text) == plain


@pytest.mark.parametrize("pattern", [tx.PAYWALL_EXPLICIT, "of the .*sh|de la .*on", r"\bab\b|cd", "ab", "a+b|c"])
def test_plain_alternatives(spark, pattern):
    texts = ["subscribe to read", "xsubscribe to continue", "noch kein b abonnement", "already a subscriber", "of the sh", "de la x on", "ab", "xab", "cd", "aab", "c", ""]
    assert evaluate(spark, texts, lambda c: tx.has_any_of(c, pattern)) == evaluate(spark, texts, lambda c: c.rlike(pattern))
