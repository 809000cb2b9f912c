"""From hits to an answer's closed set of candidates, and the checks of an answer against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx


def dedup_candidates(hits: DataFrame, query: str = "qid") -> DataFrame:
    """hits (query, rank, act, unit_path): a container takes in its leaves; pos is the new order.

    Of a group (act and first path segment) with its container only the best-ranked member stays; without it all
    stay, in natural order. Groups are ordered by their best rank. Different acts never share a group.
    """
    group = Window.partitionBy(query, "act", tx.stem(F.col("unit_path")))
    seen = hits.withColumn("_stem", tx.stem(F.col("unit_path"))).withColumn("_box", F.max(F.col("unit_path") == F.col("_stem")).over(group)).withColumn("_best", F.min("rank").over(group))
    kept = seen.where(~F.col("_box") | (F.col("rank") == F.col("_best")))
    order = Window.partitionBy(query).orderBy("_best", tx.natural_key(F.col("unit_path")), "rank")
    return kept.withColumn("pos", F.row_number().over(order)).drop("_stem", "_box", "_best")


def budget(df: DataFrame, groups: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """The longest start of each ordered group whose sizes fit; the first row always stays, nothing after the first overflow."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    summed = df.withColumn("_n", n).withColumn("_sum", F.sum(F.coalesce(size, F.lit(0))).over(w))
    over = F.max(F.when((F.col("_sum") > limit) & (F.col("_n") > 1), 1).otherwise(0)).over(w)
    return summed.withColumn("_over", over).where("_over = 0").withColumnRenamed("_sum", "used").drop("_n", "_over")


def candidate_ids(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("cid", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy(*groups).orderBy(*order))))


def gate(cited: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: cited ids that are candidates, ids that are not, and whether it is accepted.

    An answer is accepted when no id is outside its set and at least one is inside.
    """
    one = cited.distinct().join(candidates.select(*keys, "cid").distinct().withColumn("_ok", F.lit(True)), [*keys, "cid"], "left")
    sums = one.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_ok"), F.col("cid")))).alias("resolved"), F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("cid")))).alias("invalid")
    )
    return sums.withColumn("accepted", (F.size("invalid") == 0) & (F.size("resolved") > 0))


def lint(prose: Column, actions: Column, resolved: Column) -> dict[str, Column]:
    """Flags of an answer's free text: article numbers that no resolved citation backs, leaked ids, internal words."""
    numbers = tx.article_refs(prose, bounded=False)
    backed = tx.article_refs(resolved, bounded=False)
    return {
        "prose_refs_unbacked": F.array_sort(F.array_except(numbers, backed)),
        "leaked_cids": F.array_sort(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"\b(C\d+)\b"), 1))),
        "diyi_refs_unbacked": F.array_sort(F.array_except(tx.article_refs(actions, bounded=False), backed)),
        "prose_internal_vocab": tx.internal_words(prose),
    }
