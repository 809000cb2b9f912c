"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once; the top bits of the hash choose a bin and the rest compete for its minimum. An empty
bin takes the value of a full bin that hashing (bin, attempt) names, so that equal sets fill alike and unequal bins
borrow independently. Only the low 8 bits of each bin are kept; the chance agreement of those bits (1 in 256) is taken
out of the estimate. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, let

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
CODE_BITS = 8
WORDS = 5  # words in a shingle
PROBES = 16  # hashed attempts to find a donor before the whole ring of bins is tried
MAX_BUCKETS = 4096
_VALUE_BITS = 63 - BINS_LOG2
_EMPTY = (1 << _VALUE_BITS) - 1


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """array<long>: a hash for each run of `words` words (fewer words: the whole sequence; none: an empty array)."""
    hashes = F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Hex text of BINS codes of CODE_BITS bits; the empty text for a document without words (null, empty, blank)."""
    floor = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("bigint"), _VALUE_BITS).bitwiseOR(F.lit(_EMPTY)))
    every = F.sort_array(F.concat(F.transform(shingle_hashes(text, words), lambda x: x.bitwiseAND(F.lit((1 << 63) - 1))), floor))
    # after sorting, the first value of each bin is its minimum, or the marker that closes an empty bin
    bins = let(every, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, _VALUE_BITS) != F.shiftright(F.get(a, i - 1), _VALUE_BITS))))

    def full(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_EMPTY)) != F.lit(_EMPTY)

    def code(v: Column, x: Column, i: Column) -> Column:
        low = lambda y: y.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
        tries = [F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        ring = F.filter(F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda s: F.get(v, F.pmod(i + s * (2 * F.pmod(F.xxhash64(i), F.lit(BINS // 2)).cast("int") + 1), F.lit(BINS)))), full)
        return F.coalesce(F.when(full(x), low(x)), *[F.when(full(y), low(y)) for y in tries], low(F.get(ring, F.lit(0))))

    digits = CODE_BITS // 4
    packed = let(bins, lambda v: F.when(F.exists(v, full), F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(code(v, x, i)), digits, "0")), "")).otherwise(F.lit("")))
    return F.lower(packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two fingerprints: agreement, less what chance gives, within 0 and 1.

    Two documents without words are alike (1); one such and another are not (0); null gives null.
    """
    digits = CODE_BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS * digits), F.lit(digits)), lambda p: F.substring(a, p, F.lit(digits)) == F.substring(b, p, F.lit(digits))))
    chance = 1.0 / (1 << CODE_BITS)
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id_col, fingerprint) of each row; equal texts have equal fingerprints, null counts as empty."""
    return docs.select(F.col(f"`{id_col}`"), fingerprint(F.col(f"`{text_col}`"), words).alias("fingerprint"))


def with_next(docs: DataFrame, order_col: str, carry: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: of the row that follows by order_col, and of the first row after the last.

    Null orders come last; ties are ordered by the carried columns. Rows are dealt to ranges cut at quantiles, and the
    first row of each range is also sent to the range before it, so that a window never spans the whole table.
    """
    spark = docs.sparkSession
    far = (1 << 63) - 1
    rows = docs.withColumn("_key", F.coalesce(F.col(order_col).cast("bigint"), F.lit(far)))
    wanted = max(1, min(MAX_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    marks = [i / wanted for i in range(1, wanted)]
    least, cuts = rows.agg(F.min("_key"), F.percentile_approx("_key", marks, 10 * wanted) if marks else F.lit(None)).first()
    bounds = sorted({c for c in cuts or [] if c > least}) if least is not None else []
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = F.size(F.filter(held, lambda b: b <= F.col("_key")))
    here = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("after"))
    before = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(len(bounds) + 1)).alias("bucket"), F.lit(1).alias("after"))
    opens = F.col("_key").isin([least if least is not None else far]) | F.array_contains(held, F.col("_key"))
    dealt = rows.withColumn("_bucket", bucket).withColumn("_at", F.explode(F.when(opens, F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy("_at.bucket").orderBy("_at.after", "_key", *carry)
    out = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.where("_at.after = 0").drop("_key", "_bucket", "_at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Fingerprint each text and its edited text, whose last half comes from the next document; see with_next().

    Null counts as empty. n_chars and halves are in code points. A table of one row is followed by itself; an empty
    table gives an empty result; rows that repeat an id are all kept; other columns are ignored.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    both = with_next(base.withColumn("fingerprint", fingerprint(F.col("text"), words)), "doc_id", ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    made = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    done = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), words).alias("edited_fingerprint"), "next_fingerprint")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
