"""The exact route, pluggable models with offline stand-ins, the answer loop and the guards around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import paths, retrieval, temporal


def mentions(queries: DataFrame, keys: DataFrame, short: int = 8, limit: int = 200_000) -> DataFrame:
    """queries (qid, q) and keys (key, act) to (qid, pos, act, len): every place where a key stands in the normalised query.

    Keys of up to short characters need word borders; longer ones are found anywhere, overlaps included. The list of keys
    is broadcast, so its size is checked.
    """
    if keys.count() > limit:
        raise ValueError("too many keys to broadcast")
    n, k = F.length("qn"), F.length("key")
    spots = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    word = lambda c: c.rlike(r"(?U)\w")

    def stands(i: Column) -> Column:
        here = F.substring(F.col("qn"), i + 1, k) == F.col("key")
        left = F.when(i > 0, word(F.substring(F.col("qn"), i, F.lit(1)))).otherwise(False)
        right = F.when(i + k < n, word(F.substring(F.col("qn"), i + k + 1, F.lit(1)))).otherwise(False)
        return here & ((k > short) | (~left & ~right))

    pairs = queries.select("qid", tx.norm(F.col("q")).alias("qn")).join(F.broadcast(keys), F.contains("qn", F.col("key")))
    return pairs.select("qid", F.explode(F.filter(spots, stands)).alias("pos"), "act", k.alias("len"))


def articles(queries: DataFrame) -> DataFrame:
    """(qid, apos, article): each article number of a normalised query and where it stands; repeats are kept.

    A match begins where the matches before it and the text between them end.
    """
    named = r"(?iU)\b(?:статт\w*|ст)\.?\s*\d+(?:-\d+)?"
    found = queries.select("qid", tx.norm(F.col("q")).alias("qn")).select("qid", F.split("qn", named, -1).alias("between"), F.regexp_extract_all("qn", F.lit(f"({named})"), 1).alias("raw"))
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    each = found.select("qid", "between", "raw", F.posexplode("raw").alias("k", "one"))
    start = length(F.slice("between", 1, F.col("k") + 1)) + length(F.slice("raw", 1, F.col("k")))
    return each.select("qid", start.alias("apos"), F.regexp_extract("one", r"(\d+(?:-\d+)?)$", 1).alias("article"))


def exact_lookup(queries: DataFrame, acts: DataFrame, units: DataFrame, as_of: str | None = None, limit: int = 10, cap: int = 500) -> DataFrame:
    """Units in force that a query names by act and article: natural order and cap within an article, then round robin."""
    bound = retrieval.bind_citations(articles(queries), mentions(queries, retrieval.title_keys(acts)))
    wanted = bound.groupBy("qid", "act", F.concat(F.lit("ст."), "article").alias("stem")).agg(F.min("apos").alias("apos"))
    held = temporal.scope(units, as_of).withColumn("stem", tx.stem(F.col("unit_path")))
    hits = wanted.join(held, ["act", "stem"]).where(paths.under(F.col("unit_path"), F.col("stem")))
    turn = F.row_number().over(Window.partitionBy("qid", "apos", "act", "stem").orderBy(tx.natural_key(F.col("unit_path"))))
    ranked = hits.withColumn("turn", turn).where(F.col("turn") <= cap)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "apos", "act", "stem"))).where(F.col("rank") <= limit).withColumn("route", F.lit("exact"))


def lemmas(tokens: Column, dictionary: Column) -> Column:
    """Each token's base form from a map; unknown tokens stay."""
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(dictionary, t), t))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """An offline stand-in for an embedding model: signed hashed words, normalised. Not a semantic model.

    Texts stay in Arrow and become Python strings one at a time; session.ship bounds the rows of a batch.
    """

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        import hashlib

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            v = np.zeros(dim)
            for w in (t.as_py() or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = float(np.sqrt((v * v).sum()))
            out[i] = v / n if n else v
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), out.ravel())

    return embed(text)


def rerank(hits: DataFrame, query: str, score: Callable[[str, pd.Series], pd.Series] | None = None) -> DataFrame:
    """hits (text) by a scorer of (query, texts), best first; without one, the share of the query's words that a text has."""

    def overlap(q: str, texts: pd.Series) -> pd.Series:
        words = set(q.lower().split())
        return texts.map(lambda t: len(words & set((t or "").lower().split())) / max(1, len(words)))

    use = score or overlap

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(rerank_score=use(query, pdf["text"]).astype("float64"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return hits.mapInPandas(work, f"{kinds}, rerank_score double").orderBy(F.desc("rerank_score"))


def missing_cache(chunks: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Distinct texts whose hash the cache does not hold for a version."""
    return chunks.select("content_hash", "text").dropDuplicates(["content_hash"]).join(cache.where(F.col("version") == version), "content_hash", "left_anti")


def verdict(abstain: bool, resolved: list, invalid: list) -> str:
    """What an attempt leads to: the model's own abstention ends, an id outside the set or no id inside it is tried again."""
    return "abstain" if abstain else "accept" if not invalid and resolved else "retry"


def answer(ask: Callable[[int], dict], candidates: set[str], retries: int = 2) -> dict:
    """Ask until an answer passes the gate; after the last attempt abstain. ask(attempt) gives ids and abstain."""
    attempts = []
    for n in range(retries + 1):
        got = ask(n)
        ids = list(dict.fromkeys(got.get("ids", [])))
        invalid = [i for i in ids if i not in candidates]
        resolved = [i for i in ids if i in candidates]
        state = verdict(bool(got.get("abstain")), resolved, invalid)
        attempts.append({"invalid": invalid, "resolved": resolved, "verdict": state})
        if state != "retry":
            return {"abstained": state == "abstain", "resolved": resolved if state == "accept" else [], "attempts": attempts}
    return {"abstained": True, "resolved": [], "attempts": attempts}


def carries_mark(message: object, mark: str) -> bool:
    """Is a mark in any string of a nested message, keys included? Anything that is no plain data counts as marked."""
    if isinstance(message, str):
        return mark in message
    if message is None or isinstance(message, (bool, int, float)):
        return False
    if isinstance(message, dict):
        return any(carries_mark(k, mark) or carries_mark(v, mark) for k, v in message.items())
    if isinstance(message, (list, tuple)):
        return any(carries_mark(x, mark) for x in message)
    return True


def reachability(status: Column, content_type: Column, body: Column) -> Column:
    """GREEN, YELLOW, RED or ERROR of a response that was not followed."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    json = (kind == "application/json") & F.startswith(F.ltrim(F.coalesce(body, F.lit(""))), F.lit("{"))
    return F.when((status == 200) & json, "GREEN").when(status == 200, "RED").when(status == 403, "YELLOW").when(status.between(300, 399), "RED").otherwise("ERROR")


def http_status(error: str | None) -> int:
    """The status of the answer service for a kind of failure."""
    return {None: 200, "invalid": 422, "unavailable": 503, "timeout": 504}.get(error, 500)


def rate_windows(requests: DataFrame, per_window: int, seconds: int = 60) -> DataFrame:
    """requests (host, t seconds, id): the window each falls in and whether it is allowed.

    A window starts with the first request after the last one ended, so each host's distinct times are walked in order,
    batch by batch with only the open window held; what comes of it is the starts that matter to each stretch of a
    window's length. Requests find theirs by host and stretch, and their turn within it by (t, id). One without a time
    belongs to the host's last window, after all others.
    """
    k = {f.name: f.dataType.simpleString() for f in requests.schema}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = start = schema = None  # the last stretch gets starts as long as its times come
        for batch in batches:
            done = []
            for host, t, stretch in zip(*(batch.column(c).to_pylist() for c in ("host", "t", "stretch")), strict=True):
                if last is None or last["host"] != host:
                    start = None
                if last is None or (last["host"], last["stretch"]) != (host, stretch):
                    done += [last] if last else []
                    last = {"host": host, "stretch": stretch, "starts": [] if start is None else [start]}
                if t is not None and (start is None or t >= start + seconds):
                    start = t
                    last["starts"].append(t)
            schema = pa.schema([("host", batch.column("host").type), ("stretch", pa.int64()), ("starts", pa.list_(batch.column("t").type))])
            yield pa.RecordBatch.from_pylist(done, schema)
        if last:
            yield pa.RecordBatch.from_pylist([last], schema)

    t = F.when(~F.isnan("t"), F.col("t")) if k["t"] in ("float", "double") else F.col("t")
    timed = requests.select("host", "t", "id", t.alias("_t"), F.floor(t.cast("double") / seconds).alias("_stretch"))
    times = timed.select("host", F.col("_t").alias("t"), F.col("_stretch").alias("stretch")).distinct()
    starts = times.repartition("host").sortWithinPartitions("host", F.col("t").asc_nulls_last()).mapInArrow(walk, f"host {k['host']}, stretch bigint, starts array<{k['t']}>")
    starts = starts.withColumnRenamed("host", "_host")
    found = timed.join(starts, F.col("host").eqNullSafe(F.col("_host")) & F.col("_stretch").eqNullSafe(F.col("stretch")))
    found = found.withColumn("start", F.array_max(F.when(F.col("_t").isNull(), F.col("starts")).otherwise(F.filter("starts", lambda x: x <= F.col("_t")))))
    turn = F.row_number().over(Window.partitionBy("host", "start").orderBy(F.col("_t").asc_nulls_last(), F.col("id").asc_nulls_last()))
    return found.withColumn("allowed", turn <= per_window).select("host", "t", "id", "start", "allowed")
