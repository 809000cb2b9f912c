"""Mixing sources to target weights by a temperature.

Each source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised.
The exponent is found by bisection, so that the mixture meets a target entropy or so that no source is repeated more than
a limit. The budget is the least at which the most reduced source is still read once as a whole, so no document is left
out. A source's budget becomes epochs of permuted blocks of permuted documents; the last, partial epoch ends within a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import landed

BLOCK_TOKENS = 50_000
MAX_BLOCKS = 4096  # of a source; blocks grow beyond
BROADCAST_ROWS = 200_000  # the plan is broadcast up to this many rows and joined by shuffle beyond


def weights(shares: dict, exponent: float) -> dict:
    """Shares to the power of exponent, normalised; a share of 0 stays 0."""
    raised = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raised.values())
    return {s: x / total for s, x in raised.items()} if total else raised


def entropy(shares: dict) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def repetition(shares: dict, exponent: float) -> float:
    """How often the most repeated source is read while the most reduced one is read once."""
    ratios = [w / shares[s] for s, w in weights(shares, exponent).items() if shares[s] > 0]
    return max(ratios) / min(ratios) if ratios else 1.0


def find_exponent(shares: dict, target_entropy: float | None = None, repetition_limit: float | None = 4.0) -> float:
    """The least exponent in [0, 1] whose repetition and entropy stay within what is asked, by bisection.

    Both fall as the exponent rises, so each limit is met from some exponent on.
    """
    def within(a: float) -> bool:
        return (repetition_limit is None or repetition(shares, a) <= repetition_limit) and (target_entropy is None or entropy(weights(shares, a)) <= target_entropy)

    low, high = 0.0, 1.0
    if within(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if within(mid) else (mid, high)
    return high


def _exponent(totals: DataFrame, target_entropy: float | None, repetition_limit: float | None) -> tuple[float, int, int]:
    """The exponent for totals (_n tokens a source), the most tokens of a source and all tokens.

    The repetition follows from the largest and the smallest share, so it is bisected on the driver; the entropy takes
    every share, so four bisections at a time are decided by one aggregation over the sources.
    """
    some = totals.where("_n > 0")
    least, most, whole = some.agg(F.min("_n"), F.max("_n"), F.sum("_n")).first()
    if not whole:
        return 0.0, 0, 0
    low = find_exponent({"least": least / whole, "most": most / whole}, None, repetition_limit)
    if target_entropy is None:
        return low, most, whole
    share, high = F.col("_n") / F.lit(float(whole)), 1.0
    for _ in range(13):
        tries = [low + (high - low) * k / 16 for k in range(16)]
        sums = some.agg(*[F.struct(F.sum(F.pow(share, a)), F.sum(F.pow(share, a) * F.log(share))) for a in tries]).first()
        spread = [math.log(z) - a * e / z for a, (z, e) in zip(tries, sums, strict=True)]
        met = next((k for k, h in enumerate(spread) if h <= target_entropy), 16)
        if met == 0:
            return low, most, whole
        low, high = tries[met - 1], tries[met] if met < 16 else high
    return high, most, whole


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _fraction(digest: Column) -> Column:
    """The first 52 bits of a hex digest, as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, repetition_limit: float | None = 4.0, seed: int = 1) -> DataFrame:
    """All columns of docs, and _source, _tokens, _epoch, _block, _weight, _position: a row each time a document is read.

    Sorting by _position gives the mixed order. Null sources form one source of their own, apart from the empty name; a
    document without words counts 0 tokens and is read once an epoch; a source without tokens has weight 0 and is read
    once. Rows that repeat an id and a count of words share their places; null ids are hashed as empty text. Columns of
    docs that carry one of the new names are replaced, all others are kept whatever their names. An empty table gives an
    empty result. Sources are never collected.
    """
    new = ["_source", "_tokens", "_epoch", "_block", "_weight", "_position"]
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    base = docs.toDF(*names.values())
    source, own = F.col(names[source_col]).cast("string"), F.coalesce(F.col(names[id_col]).cast("string"), F.lit(""))
    told = base.select("*", F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("_at"), own.alias("_own"), count_words(F.col(names[text_col])).alias("_tokens"))
    narrow = landed(told.select("_at", "_own", "_tokens"), "mix-words")
    totals = landed(narrow.groupBy("_at").agg(F.sum("_tokens").alias("_n")), "mix-totals")
    exponent, most, whole = _exponent(totals, target_entropy, repetition_limit)
    n = F.col("_n")
    raised = F.when(n > 0, F.pow(n / F.lit(float(whole or 1)), F.lit(exponent))).otherwise(0.0)
    # the budget is the least at which the largest source, the most reduced one, is read once
    budget = F.floor(n * F.pow(n / F.lit(float(most or 1)), F.lit(exponent - 1)) + 0.5).cast("long")
    norm = totals.agg(F.sum(raised)).first()[0] or 1.0
    sources = landed(
        totals.withColumn("_budget", F.when(n > 0, budget)).select(
            "_at", (raised / F.lit(norm)).alias("_weight"), F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(n / BLOCK_TOKENS).cast("int"))).alias("_blocks"),
            F.coalesce(F.expr("_budget div _n"), F.lit(1)).cast("long").alias("_full"), F.coalesce(F.col("_budget") % n, F.lit(0)).cast("long").alias("_left"), F.coalesce(F.col("_budget") / n, F.lit(1.0)).alias("_epochs"),
        ),
        "mix-sources",
    )
    rows, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.col("_blocks") * (F.col("_full") + 1)), F.lit(0))).first()
    # a source's row is small and there is one a source, so this join moves no document when it is broadcast
    few = F.broadcast if rows <= BROADCAST_ROWS else (lambda x: x)
    block = F.floor(_fraction(_digest(seed, "block", F.col("_own"))) * F.col("_blocks")).cast("int")
    deal = lambda df: df.join(few(sources.select("_at", "_blocks")), "_at").withColumn("_block", block).drop("_blocks")
    dealt = deal(narrow)
    sums = dealt.groupBy("_at", "_block").agg(F.sum("_tokens").alias("_size"))
    turn = Window.partitionBy("_at", "_epoch").orderBy(_digest(seed, "order", F.col("_epoch"), F.col("_at"), F.col("_block")))
    turns = (
        sums.join(few(sources), "_at")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - F.when(F.col("_left") > 0, 0).otherwise(1))))
        .withColumn("_rank", F.row_number().over(turn) - 1)
        .withColumn("_before", F.coalesce(F.sum("_size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_room", F.col("_left") - F.col("_before"))
        .where((F.col("_epoch") < F.col("_full")) | (F.col("_room") > 0))
        .withColumn("_whole", (F.col("_epoch") < F.col("_full")) | (F.col("_room") >= F.col("_size")))
        .select("_at", "_block", "_epoch", "_rank", "_blocks", "_epochs", "_weight", "_room", "_whole")
    )
    key = _digest(seed, "doc", F.col("_epoch"), F.col("_own"), F.col("_tokens"))
    # where the partial epoch ends: the last document, by its digest, that still fits into what is left of its block
    ends = turns.where(~F.col("_whole"))
    split = dealt.join(few(ends.select("_at", "_block", "_epoch", "_room")), ["_at", "_block"]).withColumn("_key", key)
    running = F.sum("_tokens").over(Window.partitionBy("_at", "_block").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = split.withColumn("_sum", running).where("_sum <= _room").groupBy("_at", "_block", "_epoch").agg(F.max("_key").alias("_cut"))
    plan = turns.join(cuts, ["_at", "_block", "_epoch"], "left").drop("_room")
    draws = deal(told).join(F.broadcast(plan) if size <= BROADCAST_ROWS else plan, ["_at", "_block"]).withColumn("_key", key).where(F.col("_whole") | (F.col("_key") <= F.col("_cut")))
    position = (F.col("_epoch") + (F.col("_rank") + _fraction(F.col("_key"))) / F.col("_blocks")) / F.col("_epochs")
    return draws.select(*[F.col(names[c]).alias(c) for c in docs.columns if c not in new], source.alias("_source"), "_tokens", "_epoch", "_block", "_weight", position.alias("_position"))


SQL = r"""
WITH named AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS at_source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
totals AS (SELECT at_source, sum(tokens)::BIGINT AS n FROM named GROUP BY 1),
shape AS (SELECT max(n)::DOUBLE AS most, min(n)::DOUBLE AS least, sum(n)::DOUBLE AS whole FROM totals WHERE n > 0),
expo AS (SELECT CASE WHEN least = most THEN 0.0 ELSE greatest(0.0, 1 - ln(4.0) / ln(most / least)) END AS a, most, whole FROM shape),
goal AS (SELECT at_source, n, CASE WHEN n > 0 THEN pow(n / whole, a) / (SELECT sum(pow(t.n / x.whole, x.a)) FROM totals t, expo x WHERE t.n > 0) ELSE 0 END AS weight,
  CASE WHEN n > 0 THEN floor(n * pow(n / most, a - 1) + 0.5)::BIGINT ELSE 0 END AS budget FROM totals, expo),
sources AS (SELECT at_source, n, weight, greatest(1, least(4096, CAST(ceil(n / 50000.0) AS INTEGER))) AS blocks,
  CASE WHEN n > 0 THEN budget // n ELSE 1 END AS full_n, CASE WHEN n > 0 THEN budget % n ELSE 0 END AS left_n, CASE WHEN n > 0 THEN budget::DOUBLE / n ELSE 1.0 END AS epochs FROM goal),
dealt AS (SELECT d.*, CAST(floor(('0x' || substr(md5('1|block|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 * blocks) AS INTEGER) AS block FROM named d JOIN sources USING (at_source)),
sums AS (SELECT at_source, block, sum(tokens)::BIGINT AS size FROM dealt GROUP BY 1, 2),
exploded AS (SELECT s.*, size, block, unnest(range(full_n + CASE WHEN left_n > 0 THEN 1 ELSE 0 END)) AS epoch FROM sums JOIN sources s USING (at_source)),
turns0 AS (SELECT *, row_number() OVER w - 1 AS rnk, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM exploded
  WINDOW w AS (PARTITION BY at_source, epoch ORDER BY md5('1|order|' || epoch || '|' || at_source || '|' || block))),
turns AS (SELECT *, left_n - earlier AS room, epoch < full_n OR left_n - earlier >= size AS fits FROM turns0 WHERE epoch < full_n OR left_n - earlier > 0),
keyed AS (SELECT d.doc_id, d.tokens, t.*, md5('1|doc|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || d.tokens) AS k FROM dealt d JOIN turns t USING (at_source, block)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY at_source, block, epoch ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM keyed)
SELECT doc_id, CASE WHEN at_source <> '' THEN substr(at_source, 2) END AS source, tokens, epoch, block, round(weight, 9) AS weight, round((epoch + (rnk + ('0x' || substr(k, 1, 13))::BIGINT / 4503599627370496.0) / blocks) / epochs, 9) AS position
FROM summed WHERE fits OR running <= room
"""
