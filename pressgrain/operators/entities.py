"""Entities in text: keyword families, aliases, company keys and their joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgrain.functions.text import bound, norm_text
from pressgrain.operators.dedup import written
from pressgrain.scale import is_small


def keyword_variants(keywords: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each keyword with itself and the distinct variants of its synonym family; the families are a plan parameter."""
    rows = [(v, list(vs)) for vs in families.values() for v in vs]
    lookup = keywords.sparkSession.createDataFrame(rows, "variant string, family array<string>")
    lookup = lookup.select(norm_text(F.col("variant")).alias("keyword"), "family")
    joined = keywords.join(F.broadcast(lookup), "keyword", "left")
    family = F.coalesce("family", F.array().cast("array<string>"))
    return joined.select("keyword", F.array_distinct(F.concat(F.array("keyword"), family)).alias("variants"))


def company_key_match(left: DataFrame, right: DataFrame, key: str, min_chars: int = 3) -> DataFrame:
    """Pairs whose keys are equal or one a prefix of the other (three or more characters).

    Each key emits its own prefixes and meets the other side's full keys by equality, so no two keys are compared
    only because they start alike.
    """
    def prefixes(df: DataFrame) -> DataFrame:
        lengths = F.sequence(F.lit(min_chars), F.length(key))
        usable = df.where(F.length(key) >= min_chars)
        return usable.withColumn("__p", F.explode(F.transform(lengths, lambda n: F.substring(F.col(key), 1, n))))

    a, b = left.withColumnRenamed(key, "__a"), right.withColumnRenamed(key, "__b")
    a, b = a.where(F.length("__a") >= min_chars), b.where(F.length("__b") >= min_chars)
    left_long = prefixes(left).withColumnRenamed(key, "__a").join(b, F.col("__p") == F.col("__b")).drop("__p")
    right_long = prefixes(right).withColumnRenamed(key, "__b").join(a, F.col("__p") == F.col("__a")).drop("__p")
    right_long = right_long.where(F.col("__a") != F.col("__b"))
    cols = [*[c for c in left.columns if c != key], *[c for c in right.columns if c != key], "__a", "__b"]
    both = left_long.select(*cols).unionByName(right_long.select(*cols))
    return both.withColumn("exact", F.col("__a") == F.col("__b")).drop("__a", "__b")


def _anchor(alias):
    """The longest token of an alias: the one the text must contain for the alias to occur."""
    return F.element_at(F.array_sort(F.transform(F.split(alias, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]


def alias_words(aliases: DataFrame, min_chars: int = 3) -> DataFrame:
    """Distinct (company, alias) in folded form with the alias's longest word."""
    alias = aliases.select("company", norm_text(F.col("alias")).alias("alias")).where(F.length("alias") >= min_chars).distinct()
    return alias.withColumn("word", _anchor(F.col("alias")))


def _pairs(n: Column) -> Column:
    """All pairs of neighbours among the words of a folded text."""
    return bound(F.split(n, " "), lambda words: F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _phrase_keys(n: Column) -> Column:
    """The distinct words of a folded text and its distinct pairs of neighbours."""
    return F.array_distinct(F.concat(F.split(n, " "), _pairs(n)))


def _rarest_keys(alias: DataFrame) -> DataFrame:
    """(alias, `__key`): of each alias the pair of neighbours that the fewest aliases have, the longest of these, or its one word."""
    pairs = alias.select("alias").distinct().select("alias", F.explode(F.when(F.contains("alias", F.lit(" ")), _pairs(F.col("alias"))).otherwise(F.array("alias"))).alias("pair"))
    counts = pairs.distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, "pair").groupBy("alias").agg(F.min_by("pair", F.struct("n", -F.length("pair"), "pair")).alias("__key"))


def _stands(n: Column, alias: Column) -> Column:
    # Few texts that lack the phrase hold it as letters, so few are copied.
    return F.contains(n, alias) & F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), alias, F.lit(" ")))


def match_aliases(texts: DataFrame, aliases: DataFrame, min_chars: int = 3, holds: Callable[[Column, Column], Column] = _stands, most_aliases: int = 500_000, few: int = 256) -> DataFrame:
    """(doc_id, company, alias) for every alias that occurs as a whole phrase in the folded text.

    Each text emits its distinct words and pairs of words; an alias, whatever number of companies has it, meets them once
    by its rarest pair of neighbours, and `holds(text, alias)` decides. At most `few` aliases are tried on each text as they are, which
    costs less than its words and pairs. Where the aliases are few enough to broadcast, all that
    happens beside the text, which is never shuffled. Otherwise (or with more than `most_aliases`) texts and aliases meet
    in a shuffle of their keys, and each text travels once, to the list of its candidates.
    """
    alias = aliases.select("company", norm_text(F.col("alias")).alias("alias")).where(F.length("alias") >= min_chars).distinct()
    alias = written(alias, "aliases")
    docs = texts.select("doc_id", norm_text(F.col("text")).alias("n"))
    if is_small(alias, few):
        phrases = alias.groupBy("alias").agg(F.collect_list("company").alias("companies"))
        phrases = phrases.agg(F.collect_list(F.struct("alias", "companies")).alias("__phrases")).scalar()
        met = docs.select("doc_id", "n", F.explode(F.array(phrases)).alias("__phrases")).select("doc_id", F.explode(F.filter("__phrases", lambda p: holds(F.col("n"), p["alias"]))).alias("p"))
        return met.select("doc_id", F.explode("p.companies").alias("company"), "p.alias")
    if is_small(alias, most_aliases):
        phrases = alias.groupBy("alias").agg(F.collect_list("company").alias("__companies")).join(_rarest_keys(alias), "alias")
        met = docs.select("doc_id", "n", F.explode(_phrase_keys(F.col("n"))).alias("__key")).join(F.broadcast(phrases), "__key")
        return met.where(holds(F.col("n"), F.col("alias"))).select("doc_id", F.explode("__companies").alias("company"), "alias")
    met = docs.select("doc_id", F.explode(_phrase_keys(F.col("n"))).alias("__key")).join(_rarest_keys(alias), "__key")
    asked = met.groupBy("doc_id").agg(F.collect_set("alias").alias("__asked"))
    found = F.filter("__asked", lambda a: holds(F.col("n"), a))
    return docs.join(asked, "doc_id").select("doc_id", F.explode(found).alias("alias")).join(alias, "alias").select("doc_id", "company", "alias")


# Fixed values (over folded text): entity words before a single-word name, prepositions of ownership before it, acting verbs
# and business words after it, which show that it is meant as a company.
ENTITY_BEFORE = (
    r"\b(?:marke\w*|brand\w*|unternehmen\w*|company|konzern\w*|group|gruppe\w*|retailer\w*|handler\w*|hersteller\w*|"
    r"anbieter\w*|discounter\w*|tochter\w*|ceo|chef\w*|vorstand\w*)\b(?:\s+\w+){0,4}\s*$"
)
OWNER_BEFORE = r"\b(?:bei|von|fur|des|der|durch)\s*$"
ACTOR_AFTER = (
    r"^\s*\b(?:announc\w*|launch\w*|introduc\w*|invest\w*|acquir\w*|expand\w*|open\w*|plan\w*|partner\w*|report\w*|sell\w*|"
    r"grow\w*|appoint\w*|meld\w*|kundig\w*|start\w*|bring\w*|fuhr\w*|investier\w*|ubern\w*|expandier\w*|eroffn\w*|plan\w*|"
    r"kooperier\w*|steiger\w*|wach\w*|beruf\w*|senk\w*|erhoh\w*|verzeichn\w*|positionier\w*|transformier\w*)\b"
)
BUSINESS_AFTER = (
    r"\b(?:marke\w*|brand\w*|unternehmen\w*|company|konzern\w*|group|gruppe\w*|retailer\w*|handler\w*|hersteller\w*|"
    r"anbieter\w*|discounter\w*|umsatz\w*|produkt\w*|sortiment\w*|strategie\w*|kampagn\w*|kunde\w*|consumer\w*|store\w*|"
    r"filial\w*|markt\w*)\b"
)


def company_in_context(norm, term, before: int = 120, after: int = 180, entity=ENTITY_BEFORE, owner=OWNER_BEFORE,
                       actor=ACTOR_AFTER, business=BUSINESS_AFTER):
    """A one-word name with an entity word before it, an acting verb after it, or an owner and a business word."""
    wide = F.concat(F.lit(" "), F.replace(norm, F.lit(" "), F.lit("  ")), F.lit(" "))
    parts = F.split(wide, F.concat(F.lit(" \\Q"), term, F.lit("\\E ")), -1)

    def side(arr, start, count):
        glued = F.call_function("array_join", F.slice(arr, start, count), F.concat(F.lit(" "), term, F.lit(" ")))
        return F.regexp_replace(glued, r"\s+", " ")

    def test(arr):
        def at(i):
            left = F.right(side(arr, F.greatest(F.lit(1), i - 40), F.least(i, F.lit(41))), F.lit(before))
            right = F.left(side(arr, i + 1, 60), F.lit(after))
            return left.rlike(entity) | right.rlike(actor) | (left.rlike(owner) & right.rlike(business))

        return F.when(F.size(arr) > 1, F.exists(F.sequence(F.lit(1), F.size(arr) - 1), at)).otherwise(F.lit(False))

    return F.transform(F.array(parts), test)[0]


def match_companies(texts: DataFrame, aliases: DataFrame, **context) -> DataFrame:
    """Alias matches, single-word names only where their surroundings show a company."""
    def holds(n: Column, alias: Column) -> Column:
        return _stands(n, alias) & (F.contains(alias, F.lit(" ")) | company_in_context(n, alias, **context))

    return match_aliases(texts, aliases, holds=holds)
