"""Exact deduplication by a Golomb-coded fingerprint exchange.

Rows live in blocks (a stretch of rows of one input file). Each block sorts its distinct fingerprints, cut to
log2(rows) + guard bits, and sends them Golomb-Rice-coded to the owners of their hash ranges. An owner answers each
block with a bitmap of the fingerprints that other blocks hold too. Only rows marked there, or repeated inside their
block, are suspects; only their texts are shuffled and compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, unused
from tidemark.session import landed, ship

BLOCK_SHIFT = 20  # rows of a file in a block, as a power of two
PAGE_SHIFT = 16  # rows in a page of the suspects' bitmap, as a power of two


def rice_encode(sorted_values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Golomb-Rice code (parameter 2**k) of the gaps of ascending distinct values: unary quotients, packed remainders."""
    gaps = np.diff(sorted_values, prepend=np.int64(0))
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(unary: bytes, rest: bytes, k: int, n: int) -> np.ndarray:
    """The values that rice_encode() took."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (low << np.arange(k)).sum(axis=1))


def _shorten(fp: pd.Series, bits: int) -> np.ndarray:
    return (fp.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _send(bits: int, owners: int):
    width = -(-(1 << bits) // owners)

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(_shorten(pdf["fp"], bits))
        owner = values // width
        out = []
        for o, part in zip(*_runs(owner, values), strict=True):
            local = part - o * width
            k = max(0, int(math.log2(max(1.0, 0.69 * width / len(part)))))
            out.append((key[0], key[1], int(o), len(part), k, *rice_encode(local, k)))
        return pd.DataFrame(out, columns=["file", "block", "owner", "n", "k", "unary", "rest"])

    return block


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    """Split values where the ascending keys change."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return [p[0] for p in np.split(keys, cuts)] if len(keys) else [], np.split(values, cuts) if len(keys) else []


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """At an owner: which fingerprints do two or more blocks hold?"""
    parts = [rice_decode(r.unary, r.rest, r.k, r.n) for r in pdf.itertuples()]
    values, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    seen = np.split((counts[inverse] > 1).astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "owner": pdf["owner"], "n": pdf["n"], "bits": [np.packbits(s).tobytes() for s in seen]})


def _mark(bits: int):
    def block(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        values, inverse, counts = np.unique(_shorten(rows["fp"], bits), return_inverse=True, return_counts=True)
        replies = replies.sort_values("owner")
        told = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(replies["bits"], replies["n"], strict=True)])
        hit = rows["row"].to_numpy(np.int64)[((told == 1) | (counts > 1))[inverse]]
        out = []
        hit.sort()
        for page, inside in zip(*_runs(hit >> PAGE_SHIFT, hit & ((1 << PAGE_SHIFT) - 1)), strict=True):
            flags = np.zeros(1 << PAGE_SHIFT, np.uint8)
            flags[inside] = 1
            out.append((key[0], int(page), np.packbits(flags, bitorder="little").view("<i8")))
        return pd.DataFrame(out, columns=["file", "page", "words"])

    return block


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _placed(docs: DataFrame) -> DataFrame:
    """docs itself if its rows have places in files, else docs landed in the shared folder."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    if "_metadata" not in docs.columns and docs.inputFiles():
        try:
            docs.select(*place).schema  # noqa: B018  analysed here, so that a frame without places is found now
            return docs
        except AnalysisException:
            pass
    return landed(docs.withColumnsRenamed({"_metadata": "_metadata_"}), "dedup-input")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file, row, id, text): each row's place in its input file."""
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guard_bits: int = 10, bitmap_limit: int = 64 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of white space became one space; null counts as empty, so null and
    empty texts form one group. Of equal texts the smallest id stays (null ids count as largest); of rows that repeat
    id and text alike the first by file and row stays. Other columns are ignored whatever their names. An empty table
    gives an empty result. bitmap_limit bounds what is broadcast (a bit a row); beyond it the input files are taken in
    groups whose bitmaps fit.
    """
    return _decided(_placed(docs), id_col, text_col, guard_bits, bitmap_limit).drop("file", "row")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns.

    The places of dropped rows are broadcast up to broadcast_rows of them (then texts stay where they are), and joined by
    shuffle beyond.
    """
    clash = "_metadata" in docs.columns
    docs = _placed(docs)
    names = [unused(n, docs.columns) for n in ("at_file", "at_row", "gone_file", "gone_row")]
    dropped = landed(_decided(docs, id_col, text_col, 10, 64 << 20).where("NOT kept").select(F.col("file").alias(names[2]), F.col("row").alias(names[3])), "dedup-dropped")
    few = F.broadcast(dropped) if dropped.count() <= broadcast_rows else dropped
    here = docs.withColumns({names[0]: F.col("_metadata.file_path"), names[1]: F.col("_metadata.row_index")})
    return here.join(few, (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left_anti").drop(*names[:2]).withColumnsRenamed({"_metadata_": "_metadata"} if clash else {})


def _decided(docs: DataFrame, id_col: str, text_col: str, guard_bits: int, bitmap_limit: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    source = _addressed(docs, id_col, text_col)
    norm = normalised(F.col("text"))
    rows = landed(source.select("file", "row", "id", F.xxhash64(norm).alias("fp"), F.unhex(F.sha2(norm, 256)).alias("sha")), "dedup-rows")
    total = rows.count()
    bits = max(8, min(62, math.ceil(math.log2(max(2, total))) + guard_bits))
    owners = min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> BLOCK_SHIFT))
    keyed = rows.select("file", F.shiftright("row", BLOCK_SHIFT).alias("block"), "row", "fp")
    sent = landed(
        keyed.select("file", "block", "fp").groupBy("file", "block").applyInPandas(_send(bits, owners), "file string, block long, owner long, n int, k int, unary binary, rest binary"),
        "dedup-sent",
    )
    replies = sent.groupBy("owner").applyInPandas(_judge, "file string, block long, owner long, n int, bits binary")
    pages = landed(
        keyed.groupBy("file", "block").cogroup(replies.groupBy("file", "block")).applyInPandas(_mark(bits), "file string, page long, words array<bigint>"),
        "dedup-pages",
    )
    page_bytes = (1 << PAGE_SHIFT) // 8 + 256
    sizes = {r["file"]: r["n"] * page_bytes for r in pages.groupBy("file").agg(F.count("*").alias("n")).toLocalIterator()}
    groups: list[list[str]] = [[]]
    held = 0
    for file, size in sorted(sizes.items()):
        if held and held + size > bitmap_limit:
            groups.append([])
            held = 0
        groups[-1].append(file)
        held += size
    bit = F.getbit(F.get("words", F.shiftright(F.col("row").bitwiseAND((1 << PAGE_SHIFT) - 1), 6).cast("int")), F.col("row").bitwiseAND(63).cast("int"))
    suspects = None
    for group in groups:
        some, its_pages = (source, pages) if len(groups) == 1 else (source.where(F.col("file").isin(group)), pages.where(F.col("file").isin(group)))
        page_of = F.shiftright("row", PAGE_SHIFT)
        marked = some.withColumn("page", page_of).join(F.broadcast(its_pages), ["file", "page"]).where(bit == 1).select("id", "file", "row", "text")
        suspects = marked if suspects is None else suspects.unionAll(marked)
    place = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("file").alias("file"), F.col("row").alias("row"))
    classes = (
        suspects.select(normalised(F.col("text")).alias("norm"), place.alias("place"))
        .groupBy("norm")
        .agg(F.min("place").alias("keep"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "n")
        .groupBy("sha")
        .agg(F.min("keep").alias("keep"), F.max("n").alias("n"), F.count("*").alias("texts"))
        .where(F.coalesce(F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts share one sha256")).cast("boolean")), F.lit(True)))
        .drop("texts")
    )
    first = F.col("keep").isNull() | ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))
    return rows.join(classes, "sha", "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        first.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "file",
        "row",
    )


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
