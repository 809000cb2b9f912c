"""Pinned cases of the exact route, the answer loop and its guards."""

from pyspark.sql import functions as F

from tidemark.operators import answers, quality
from tidemark.plans import more


def test_exact_lookup_binds_to_the_right_and_interleaves(spark, small):
    out = {}
    for r in more.co06_exact_lookup(spark, small).orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["act"], r["unit_path"]))
    assert out[1] == [("A-1", "ст.5"), ("B-2", "ст.7"), ("A-1", "ст.5/п.2"), ("B-2", "ст.7/п.2"), ("A-1", "ст.5/п.10"), ("B-2", "ст.7/п.10")]
    assert 2 not in out and out[3] == [("B-2", "ст.50"), ("B-2", "ст.50/п.2"), ("B-2", "ст.50/п.10")]


def test_short_keys_need_borders(spark):
    keys = spark.createDataFrame([("кас", "X"), ("дуже довга назва", "Y")], "key string, act string")
    q = spark.createDataFrame([(1, "каса і кас"), (2, "прадуже довга назва")], "qid int, q string")
    assert sorted((r["qid"], r["pos"], r["act"]) for r in answers.mentions(q, keys).collect()) == [(1, 7, "X"), (2, 3, "Y")]


def test_answer_loop():
    said = iter([{"ids": ["C9"]}, {"ids": []}, {"ids": ["C1", "C1"]}])
    out = answers.answer(lambda n: next(said), {"C1"})
    assert not out["abstained"] and out["resolved"] == ["C1"] and len(out["attempts"]) == 3
    assert answers.answer(lambda n: {"ids": ["C1", "C2"]}, {"C1"})["abstained"]
    own = answers.answer(lambda n: {"ids": ["C1"], "abstain": True}, {"C1"})
    assert own["abstained"] and own["resolved"] == [] and len(own["attempts"]) == 1


def test_mark_is_found_anywhere_and_unknown_types_fail_closed():
    assert answers.carries_mark({"a": [{"b": ("x", "yMARKz")}]}, "MARK") and answers.carries_mark({"MARK": 1}, "MARK")
    assert not answers.carries_mark({"a": [1, None, "x"]}, "MARK") and answers.carries_mark({"a": object()}, "MARK")


def test_rerank_and_embedding(spark):
    hits = spark.createDataFrame([(1, "x y"), (2, "a b c"), (3, None)], "id int, text string")
    assert [r["id"] for r in answers.rerank(hits, "a b").collect()][0] == 2
    assert [r["id"] for r in answers.rerank(hits, "q", lambda q, t: t.str.len().fillna(9)).collect()] == [3, 2, 1]
    v = hits.select(answers.hashed_embedding(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-6 and sum(v[2]["v"]) == 0


def test_embedding_of_every_document_in_bounded_batches(spark, small):
    """As plain Python has it; texts go to workers in batches of bounded rows."""
    import hashlib

    import numpy as np
    import pandas as pd

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = more.co09_embed(spark, small)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2_000

    def one(t):
        v = np.zeros(64)
        for w in ("passage: " + t).lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 64] += 1 if h >> 63 else -1
        return (v / np.sqrt((v * v).sum())).astype("f4").tolist()

    docs = pd.read_parquet(f"{small}/documents.parquet")
    assert {r["doc_id"]: r["v"] for r in out.collect()} == {i: one(t) for i, t in zip(docs["doc_id"], docs["text"])}


def test_rate_windows(spark):
    df = spark.createDataFrame([("h", t, i) for i, t in enumerate((0, 10, 59, 60, 61, 200))], "host string, t long, id int")
    out = [(r["start"], r["allowed"]) for r in answers.rate_windows(df, 2).orderBy("id").collect()]
    assert out == [(0, True), (0, True), (0, False), (60, True), (60, True), (200, True)]


def test_rate_windows_walk_in_small_batches(spark):
    """Many requests at once, missing hosts and times, fractions of seconds: as a plain walk has it; no frame holds a host's rows."""
    import random

    rng = random.Random(5)
    when = lambda i: None if i % 97 == 5 else rng.choice((rng.randrange(-200, 900), rng.randrange(60)))
    for kind, shift in (("long", 0), ("double", 0.25)):
        rows = [(rng.choice(("a", "a", "a", "b", None)), when(i), i) for i in range(1_500)] + [("void", None, 2_000 + i) for i in range(5)]
        rows = [(h, t if t is None or not shift else t + shift * (i % 4), i) for h, t, i in rows]
        want, open_ = {}, {}
        for h, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2])):
            start, used = open_.get(h, (None, 0))
            if t is not None and (start is None or t >= start + 60):
                start, used = t, 0
            open_[h] = start, used + 1
            want[i] = (h, t, start, used < 3)
        df = spark.createDataFrame([(h, t if t is None or kind == "long" else float(t), i) for h, t, i in rows], f"host string, t {kind}, id long")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = answers.rate_windows(df, 3)
        assert {r["id"]: (r["host"], r["t"], r["start"], r["allowed"]) for r in out.collect()} == want
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == ["host", "t", "id", "start", "allowed"]


def test_cache_version(spark):
    chunks = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", "c")], "content_hash string, text string")
    cache = spark.createDataFrame([("h1", "v1"), ("h2", "v0")], "content_hash string, version string")
    assert sorted(r["content_hash"] for r in answers.missing_cache(chunks, cache, "v1").collect()) == ["h2", "h3"]


def test_http_status():
    assert [answers.http_status(x) for x in (None, "invalid", "unavailable", "timeout", "else")] == [200, 422, 503, 504, 500]


def test_each_article_binds_at_its_own_place(spark):
    """An article found inside another's number, and one named twice, keep the places where they stand."""
    acts = spark.createDataFrame([("A-1", None), ("B-2", None)], "act string, title string")
    units = spark.createDataFrame([(a, f"ст.{n}") for a in ("A-1", "B-2") for n in (5, 50)], "act string, unit_path string")
    units = units.withColumn("in_force_from", F.lit("2020-01-01").cast("date")).withColumn("in_force_to", F.lit(None).cast("date"))
    q = spark.createDataFrame([(1, "ст. 50 закону A-1 і ст. 5 закону B-2"), (2, "ст. 5 закону A-1 і ст. 5 закону B-2"), (3, "стаття 5 A-1, ст.5 A-1")], "qid int, q string")
    got = {(r["qid"], r["act"], r["unit_path"]) for r in answers.exact_lookup(q, acts, units, "2024-01-01").collect()}
    assert got == {(1, "A-1", "ст.50"), (1, "B-2", "ст.5"), (2, "A-1", "ст.5"), (2, "B-2", "ст.5"), (3, "A-1", "ст.5")}


def test_phrases_in_groups(spark):
    texts = spark.createDataFrame([(1, "abc def"), (2, None), (3, "xbcx"), (4, "")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "bc"), (2, "c d"), (3, ""), (4, None), (5, "bc")], "item_id long, phrase string")
    want = {(1, 1), (1, 2), (1, 3), (1, 5), (3, 1), (3, 3), (3, 5), (4, 3)}
    for chars in (1, 1000):
        assert {tuple(r) for r in quality.phrases_in(texts, phrases, chars).collect()} == want
