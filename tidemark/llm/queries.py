"""The training-data operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, exact_dedup, fingerprint, language, lm, mixing, near_dedup, tokenfile, toxicity
from tidemark.llm.common import fold
from tidemark.session import load


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of them."""
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 4) != 2), "doc_id", "text", "lang")
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of nine tenths of them."""
    docs = load(spark, sf_dir, "documents")
    counts = lm.train(docs.where(fold("doc_id", 10) != 0))
    return lm.score(docs, counts).withColumn("held_out", fold("doc_id", 10) == 0)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from four fifths of the labelled ones."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, against themselves with the last answer exchanged, as shared prompts and masked completions."""
    return chat.preference_segments(chat.exchanged_answers(load(spark, sf_dir, "conversations")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as often as the mixture of sources reads them, each with its place in the mixed order."""
    return mixing.mix(load(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"),
        F.round("_weight", 9).alias("weight"), F.round("_position", 9).alias("position"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents' ids written to seekable files and read back, as digests."""
    manifest = tokenfile.write_tokens(load(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """All documents encoded by the multilingual byte-level ranks and decoded again, as digests."""
    docs = load(spark, sf_dir, "documents")
    both = bpe.round_trip(docs, ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents."""
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on three-word shingles from a similarity of 0.85."""
    found = near_dedup.near_duplicates(load(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_lm_score, op3_fingerprint, op4_toxicity, op5_chat_format, op6_mixing, op7_token_files, op8_bpe, op9_exact_dedup, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.SQL, "op6_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL}
