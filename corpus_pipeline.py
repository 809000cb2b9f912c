"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language, mixing, near_dedup
from tidemark.llm.common import unused
from tidemark.session import landed, load

#: Share of a document's letters that its main language must hold.
LANGUAGE_SHARE = 0.5


def _set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with the columns that an operator would replace under other names, and what gives all columns back."""
    other: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            other[c] = unused(c + "_", [*docs.columns, *other.values()])
    return docs.withColumnsRenamed(other), [F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those of which no language holds half the letters, go.
    All columns are kept as they are, also those named like the operator's results."""
    model = language.fit(docs, "doc_id", "text", "lang")
    aside, back = _set_aside(docs, ("lang_pred", "score"))
    return language.identify(aside, model, carry=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature at which none is read more than four times as often as another; every document is read
    at least once, those of small sources again, in the mixed order. Null sources are one source; null and empty texts
    have no tokens; all columns are kept as they are."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    aside, back = _set_aside(docs, ("_source", "_tokens", "_epoch", "_block", "_weight", "_position"))
    return mixing.mix(aside).repartitionByRange(parts, "_position").sortWithinPartitions("_position").select(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and digests of them and of what they decode to; null texts count as empty."""
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first and third stages are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs, f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
