"""Offerings: fit, deterministic match by ordered rules, and ranking for an article."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.text import norm_text
from pressgrain.operators.retrieval import long_words, top_entries


@dataclass(frozen=True)
class OfferingRule:
    """`offering` is chosen if all patterns match and, where triggers are named, one of them is present."""

    offering: str
    patterns: tuple[str, ...]
    triggers: tuple[str, ...] = ()


def match_offering(text: Column, trigger_ids: Column, rules: Sequence[OfferingRule], active: Sequence[str]) -> Column:
    """Offering of the first rule that matches, null if it is not active or no rule matches."""

    def cascade(n: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            ok = F.lit(True)
            for pattern in rule.patterns:
                ok = ok & n.rlike(pattern)
            if rule.triggers:
                ok = ok & F.arrays_overlap(trigger_ids, F.array(*[F.lit(t) for t in rule.triggers]))
            choice = F.lit(rule.offering) if rule.offering in active else F.lit(None).cast("string")
            out = F.when(ok, choice).otherwise(out)
        return out

    return F.transform(F.array(norm_text(text)), cascade)[0]


def offering_fit(offering_id: Column, concept_text: Column, text: Column, strict: Mapping[str, str], stop: Sequence[str], stem: int = 7) -> Column:
    """Strict pattern of the offering where it has one, else any word that starts with a concept stem of seven letters."""
    n = norm_text(text)
    concepts = F.transform(F.filter(F.split(norm_text(concept_text), " "), lambda w: (F.length(w) >= stem) & ~w.isin(*stop)), lambda w: F.substring(w, 1, stem))
    words = F.array_distinct(F.transform(F.split(n, " "), lambda w: F.substring(w, 1, stem)))
    out = F.arrays_overlap(concepts, words)
    for name, pattern in strict.items():
        out = F.when(offering_id == name, n.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def rank_offerings(articles: DataFrame, offerings: DataFrame, preferred: Mapping[str, Sequence[str]], k: int = 10,
                   stop: Sequence[str] = (), min_score: int = 10, shard_words: int = 2_000_000) -> DataFrame:
    """Best `k` offerings per article: family preference, shared words (up to eight) and the literal label.

    `articles` has doc_id, text and families; `offerings` has offering_id, label, description and position. An article
    carries its best offerings past the shards of an index of the catalogue (`retrieval`), so neither pairs of articles and
    offerings nor texts are shuffled. Equal scores are ordered by position, then by offering_id.
    """
    words = long_words(norm_text(F.concat_ws(" ", "label", "description")))
    words = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    catalogue = offerings.select("offering_id", "position", norm_text(F.col("label")).alias("label"), words.alias("words"))
    pairs = [x for f, ids in preferred.items() for x in (F.lit(f), F.array(*[F.lit(i) for i in ids]))]
    kind = offerings.schema["offering_id"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    wanted = F.flatten(F.transform("families", lambda f: F.coalesce(F.try_element_at(F.create_map(*pairs), f), none))) if pairs else none
    return top_entries(articles.select("doc_id", norm_text(F.col("text")).alias("n"), wanted.alias("wanted")), catalogue, k, min_score, shard_words)
