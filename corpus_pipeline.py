"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of the documents they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgrain.llm import copies, packing, paragraphs, passages, secrets, toxicity
from pressgrain.llm.common import saved, settled
from pressgrain.llm.queries import tokenizer_file
from pressgrain.session import checkpoint_dir


#: Rows that Spark hands to Python at once. Its own 10,000 rows of whole texts are held four times over in a task.
BATCH_ROWS = "1000"


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with all columns but id and text under names that no operator uses, and each column's new name."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    names = {c: c if c in ("doc_id", "text") else f"__own_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(own).alias(c) for c, own in names.items()))


def _recounted(found: DataFrame, names: dict[str, str], kind, changed: Column) -> DataFrame:
    """`n_chars`, where there is such a column, follows the text of the rows that changed."""
    own = names.get("n_chars")
    return found.withColumn(own, F.when(changed, F.length("text").cast(kind)).otherwise(F.col(own))) if own else found


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the network of op5 scores below one half. Null and empty texts score 0 and stay; repeated rows stay,
    columns keep their values whatever their names, an empty table stays empty."""
    net = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    own, names = _apart(docs)
    return _back(toxicity.score(own, net).where("predicted = 0"), names)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies (five-word Jaccard 0.8), the one of the smallest id (null ids last);
    repeated rows count as copies. Candidates are the fingerprints that op8's forest of vantage-point trees links, and texts
    beyond its radius that share a MinHash band; every link is checked by exact similarity.

    Texts without words are copies of each other, so of them one stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    found = saved(copies.near_copies(docs), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "name")
    # Classes of null ids only have no name: each of their texts counts as a class.
    nameless = F.when(F.col("component_id").isNull(), F.col("name"))
    stays = found.groupBy("component_id", nameless.alias("nameless")).agg(F.min(place).alias("stay")).select(F.col("stay.doc_id").alias("__id"), F.col("stay.name").alias("__stays"))
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(stays["__id"]), "left_semi")
    shared = found.groupBy("doc_id").count().where("count > 1")
    if not shared.take(1):
        return kept
    # Some rows share an id: of each id's rows with the words that stay, the one with the smallest text stays.
    ids = shared.select(F.col("doc_id").alias("__id"))
    single = kept.join(ids, kept["doc_id"].eqNullSafe(ids["__id"]), "left_anti")
    several = kept.join(ids, kept["doc_id"].eqNullSafe(ids["__id"]), "left_semi")
    held = several.join(copies.named(several), F.col("text").eqNullSafe(F.col("__text")))
    held = held.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__name") == F.col("__stays")), "left_semi")
    first = held.groupBy("doc_id", "__name").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("row"))
    return single.unionByName(first.select("row.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the paragraphs that op4 keeps elsewhere, and without runs of 50 words that stand elsewhere, inside
    lines and across them; documents of which nothing is left go.

    Null and empty texts stay, repeated rows are one document and are cut alike. Columns keep their values whatever their
    names, but for `n_chars`, which follows the text. What one step has written is let go before the next begins.
    """
    own, names = _apart(docs)
    wanted = [*names.values(), "n_removed"]
    found = settled(spark, "paragraphs", lambda: paragraphs.remove_repeats(own).select(*wanted))
    found = passages.remove_passages(found)
    gone = F.col("n_removed") + F.col("n_words_removed") > 0
    found = found.where(~gone | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return _back(_recounted(found, names, kind, gone), names)


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts in which every span of op7 is replaced by a mark. All documents stay, null and empty texts and repeated rows
    as they are. Columns keep their values whatever their names, but for `n_chars`, which follows the text."""
    own, names = _apart(docs)
    found = secrets.redact(secrets.scan(own))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return _back(_recounted(found, names, kind, F.size("spans") > 0), names)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed by op10. A null or empty text is its end id alone, repeated
    rows are packed each, other columns are ignored, an empty table gives no pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: No stage but the fourth can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the folder's documents; each result goes through a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    top = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, folder).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
