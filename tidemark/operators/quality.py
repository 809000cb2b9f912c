"""Retrieval and answer quality: ranks of gold, rates, taxonomy, sufficiency, noise, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship


def first_hit(ranked: DataFrame, query: list[str], hit: Column) -> DataFrame:
    return ranked.groupBy(*query).agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def retrieval_metrics(hits: DataFrame, group: str, k: int) -> DataFrame:
    """n, recall@k (any gold within k), p@1 and MRR@k of each group."""
    inside = F.col("hit_rank") <= k
    mean = lambda c: F.round(F.avg(c), 6)
    return hits.groupBy(group).agg(
        F.count("*").alias("n"), mean(F.when(inside, 1.0).otherwise(0.0)).alias("recall"), mean(F.when(F.col("hit_rank") == 1, 1.0).otherwise(0.0)).alias("p1"),
        mean(F.when(inside, 1.0 / F.col("hit_rank")).otherwise(0.0)).alias("mrr"),
    )


def taxonomy(gold: Column, cited: Column, abstain: Column, unbacked: Column) -> dict[str, Column]:
    """correct, null, wrong_pick and drift of an answer; one that abstained scores nothing."""
    none = F.array().cast("array<string>")
    correct = F.when(abstain, none).otherwise(F.array_sort(F.array_intersect(gold, cited)))
    return {
        "correct": correct,
        "null": F.when(abstain, none).otherwise(F.array_sort(F.array_except(gold, cited))),
        "wrong_pick": F.when(abstain, none).otherwise(F.array_sort(F.array_except(cited, gold))),
        "drift": ~abstain & (F.size(correct) > 0) & (F.size(unbacked) > 0),
    }


def sufficient(gold: Column, candidates: Column) -> Column:
    """Is every gold item among the candidates?"""
    return F.size(F.array_except(gold, candidates)) == 0


def noise(passes: DataFrame, item: str, key: str, hit: str) -> DataFrame:
    """Shares of items whose answers, or whose hits, differ between passes."""
    one = passes.groupBy(item).agg((F.countDistinct(key) > 1).cast("double").alias("s"), (F.countDistinct(hit) > 1).cast("double").alias("g"))
    return one.agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("set_flip_rate"), F.sum("g").cast("long").alias("gold_flips"))


def error_rate(runs: DataFrame, key: str, failed: Column, most: float) -> DataFrame:
    """attempted, errors and passed of each key: some were attempted and the share of errors is within most."""
    g = runs.groupBy(key).agg(F.count("*").alias("attempted"), F.count_if(failed).alias("errors"))
    return g.withColumn("passed", (F.col("attempted") > 0) & (F.col("errors") / F.col("attempted") <= most))


def validate_gold(gold: DataFrame, acts: DataFrame) -> DataFrame:
    """gold (act, article) with verdict: the act is not among acts, the article is not shaped like one, or ok."""
    known = gold.join(acts.select("act").distinct().withColumn("_known", F.lit(True)), "act", "left")
    verdict = F.when(F.col("_known").isNull(), "unknown act").when(~F.col("article").rlike(r"^ст\.\d+(-\d+)?$"), "article shape").otherwise("ok")
    return known.withColumn("verdict", verdict).drop("_known")


def phrases_in(texts: DataFrame, phrases: DataFrame, chars: int = 2_000_000) -> DataFrame:
    """texts (doc_id, text) and phrases (item_id, phrase) to (doc_id, item_id) of every phrase that a text holds.

    An automaton of the phrases runs once over each text, so work does not grow with their product. Phrases come to the
    driver in groups of at most chars characters (one that is longer alone); each group is a pass. Null texts and phrases
    match nothing; an empty phrase is in every text.
    """
    import ahocorasick
    import pyarrow as pa

    spark = texts.sparkSession
    ship(spark)
    kind, item = texts.schema["doc_id"].dataType.simpleString(), phrases.schema["item_id"].dataType.simpleString()
    groups: list[list] = [[]]
    held, passes = 0, None

    def search(group: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(group)

        def work(batches):
            automaton, always, of = ahocorasick.Automaton(), [], {}
            for i, phrase in sent.value:
                of.setdefault(phrase, []).append(i)
            for phrase, ids in of.items():
                if phrase:
                    automaton.add_word(phrase, ids)
                else:
                    always = ids
            automaton.make_automaton()
            for batch in batches:
                docs, items = [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    hit = {i for _, ids in (automaton.iter(text) if text and len(automaton) else ()) for i in ids} | set(always if text is not None else ())
                    docs += [doc] * len(hit)
                    items += sorted(hit)
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field("doc_id").type), pa.array(items, pa.int64())], ["doc_id", "item_id"])

        return texts.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, item_id bigint").withColumn("item_id", F.col("item_id").cast(item))

    for r in phrases.where("phrase IS NOT NULL").select(F.col("item_id").cast("bigint"), "phrase").toLocalIterator():
        if held and held + len(r["phrase"]) > chars:
            groups.append([])
            held = 0
        groups[-1].append((r["item_id"], r["phrase"]))
        held += len(r["phrase"])
    for group in groups:
        found = search(group)
        passes = found if passes is None else passes.unionAll(found)
    return passes


def baseline_compare(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """lost, gained, moved or same for each key of the baseline; both have hit_rank."""
    b, n = F.col("base_rank"), F.col("now_rank")
    state = F.when(b.isNotNull() & n.isNull(), "lost").when(b.isNull() & n.isNotNull(), "gained").when(~b.eqNullSafe(n), "moved").otherwise("same")
    return base.withColumnRenamed("hit_rank", "base_rank").join(now.withColumnRenamed("hit_rank", "now_rank"), key, "left").withColumn("state", state)
