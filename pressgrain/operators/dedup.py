"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgrain.session import work_folder


def exact_duplicates(docs: DataFrame, hash_col: str) -> DataFrame:
    """Every copy but the first with the id it repeats and the number of copies.

    A hash may stand for a third of all rows, so its first id and count come from a partial aggregate; the join back
    sends only hashes with copies and leaves a hot hash to the skew-join rule.
    """
    groups = docs.groupBy(hash_col).agg(F.min("doc_id").alias("duplicate_of"), F.count(F.lit(1)).alias("copies"))
    rows = docs.join(groups.where("copies > 1"), hash_col)
    return rows.where(F.col("doc_id") != F.col("duplicate_of")).select("doc_id", "duplicate_of", "copies")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows through a table in the shared folder, so that later uses read it and don't compute it again."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_duplicates(docs: DataFrame, min_score: float, min_shared: int) -> DataFrame:
    """(doc_id, duplicate_of): the smallest earlier document with an equal or similar enough token set.

    Equal token sets are collapsed first, so a group of copies, however large, enters the similarity join once. Two
    distinct sets that reach Jaccard `min_score` share at least `need` tokens, so all but `need` - 2 tokens of each hold two
    of them: sets meet by the pairs of their rarest tokens of that number (by single tokens, all but `need` - 1, where one
    shared token may do). A pair of tokens indexes far fewer sets than a token. The tokens' parities in 64 bits differ in no
    more bits than the sets in tokens, which settles most pairs inside the join; the rest are compared, so the result is
    exact, not approximate.
    """
    sets = docs.where(F.size("tokens") > 0).select("doc_id", F.array_sort("tokens").alias("tokens"))
    sets = written(sets.withColumn("set_key", F.md5(F.array_join("tokens", " "))), "token-sets")
    unique = written(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("tokens").alias("tokens")), "distinct-sets")
    freq = unique.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    words = unique.select("rep", F.explode("tokens").alias("token")).join(freq, "token")
    ranked = words.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("token").alias("h")))).alias("r"))
    ranked = ranked.select("rep", F.size("r").alias("n"), F.transform("r", lambda x: x["h"]).alias("h"))
    together = 2 if min_shared >= 2 else 1
    # A partner shares at least ceil(t * n) tokens; all but that many less `together` may be skipped.
    need = F.greatest(F.ceil(F.col("n") * F.lit(min_score) - F.lit(1e-9)), F.lit(max(min_shared, 1))).cast("int")
    rare = F.slice("h", F.lit(1), F.greatest(F.lit(0), F.col("n") - need + together))
    bits = F.aggregate("h", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))
    ranked = ranked.where(need <= F.col("n")).select("rep", "n", bits.alias("bits"), rare.alias("rare"))
    pairs = F.flatten(F.transform("rare", lambda x, i: F.transform(F.slice("rare", F.lit(1), i), lambda y: F.xxhash64(y, x))))
    index = ranked.select(F.explode(pairs if together == 2 else F.col("rare")).alias("key"), "rep", "n", "bits")
    a, b = index.alias("a"), index.alias("b")
    # Of two sets at least this share of all their tokens is in both, so at most the rest differ.
    apart = (F.col("a.n") + F.col("b.n")) * ((1 - min_score) / (1 + min_score)) + 1e-9
    fits = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * min_score - 1e-9) & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= apart)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & fits)
    met = met.select(F.col("a.rep").alias("l"), F.col("b.rep").alias("r")).distinct()
    text = unique.select("rep", "tokens")
    met = met.join(text.select(F.col("rep").alias("l"), F.col("tokens").alias("lt")), "l").join(text.select(F.col("rep").alias("r"), F.col("tokens").alias("rt")), "r")
    shared = F.size(F.array_intersect("lt", "rt"))
    score = shared / F.size(F.array_union("lt", "rt"))
    best = met.where((shared >= min_shared) & (score >= min_score)).groupBy("r").agg(F.min("l").alias("l"))
    target = unique.join(best, unique["rep"] == best["r"], "left").select("set_key", F.least("rep", F.coalesce("l", "rep")).alias("duplicate_of"))
    return sets.select("doc_id", "set_key").join(target, "set_key").where(F.col("doc_id") != F.col("duplicate_of")).select("doc_id", "duplicate_of")
