"""One query per operator of this folder over its whole table, with an SQL oracle where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgrain.llm import ann, chat, merkle, packing, parity, passages, quality, secrets, sentencepiece, simhash, suffixes, toxicity, trie
from pressgrain.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; digests of ids and text."""
    model = tokenizer_file("piece_bpe_32k.model")
    ids = sentencepiece.encode(table(spark, folder, "documents"), model)
    both = sentencepiece.decode(ids, model)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut and packed into sequences of 1,024 tokens."""
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=False)


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, posterior and verdict of every document."""
    found = quality.quality(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: counts and spans of the base kinds, and the spans of all kinds."""
    found = secrets.scan(table(spark, folder, "documents"))
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, secrets.BASE),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


@query
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.summaries(chat.format_turns(turns.unionByName(chat.probe(spark))))


@query
def op1_vantage_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return ann.search(table(spark, folder, "embeddings"))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a network that never saw the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity.train(*toxicity.sample(docs, table(spark, folder, "labels")))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 200-byte strings that occur anywhere else."""
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the paragraphs, and the runs of 50 words, that are kept elsewhere; `n_removed` is the number
    of characters that went."""
    docs = table(spark, folder, "documents").withColumn("before", F.length("text"))
    found = passages.remove_repeated_text(docs)
    lost = F.coalesce(F.col("before") - F.length("text"), F.lit(0)).cast("long").alias("n_removed")
    return found.select("doc_id", lost, F.col("n_removed").alias("n_lines_removed"), "n_words_removed", "kept_in", "text")


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a leaf; those of every second checksum are folded without their line ends."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, folder, "documents"), {"text": tampered})


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All beginnings that conversations share, where each begins like the first of its twenty."""
    turns = trie.placed_turns(table(spark, folder, "conversations"))
    return trie.prefix_trie(*trie.rebuilt(turns))


@query
def op13_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of 0.85 or more."""
    return parity.similar_documents(table(spark, folder, "documents"))
