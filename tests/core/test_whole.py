"""Queries answer for every row of their tables: compared with plain Python over whole tables."""

import re

import pandas as pd

from tidemark import registry


def run(name, spark, d):
    return registry.queries()[name](spark, d).toPandas()


def table(d, name):
    return pd.read_parquet(f"{d}/{name}.parquet")


def test_norm_of_every_document(spark, small):
    def norm(t):
        t = t.lower().translate(str.maketrans("«»\"“”„‹›", " " * 8)).translate(str.maketrans("’`´ʼ", "''''"))
        return re.sub(r"\s+", " ", t).strip(" ")

    docs = table(small, "documents")
    got = run("fn01_norm", spark, small)
    assert dict(zip(got["doc_id"], got["norm"], strict=True)) == {r.doc_id: norm(r.text) for r in docs.itertuples()}


def test_lemmas_of_whole_texts(spark, small):
    base = {"was": "be", "is": "be", "are": "be"}
    docs = table(small, "documents")
    got = run("fn09_lemmas", spark, small)
    want = {r.doc_id: " ".join(base.get(w, w) for w in re.findall(r"\w+", r.text.lower())) for r in docs.itertuples()}
    assert dict(zip(got["doc_id"], got["lemmas"], strict=True)) == want


def test_noise_of_all_events(spark, small):
    events = table(small, "events")
    g = events.assign(hit=events["event_type"] == "click").groupby("user_id").agg(s=("event_type", "nunique"), g=("hit", "nunique"))
    got = run("ag12_noise", spark, small).iloc[0]
    assert (got["n"], got["set_flip_rate"], got["gold_flips"]) == (len(g), round((g["s"] > 1).mean(), 6), (g["g"] > 1).sum())


def test_stems_of_all_orders(spark, small):
    got = run("fn14_stem", spark, small)
    assert sorted(got["stem"]) == sorted({f"o{k}" for k in table(small, "lineitem")["l_orderkey"]})


def test_natural_order_of_all_parts(spark, small):
    d = small.replace("sf0.001", "sf0.01")  # the smallest tables have too few parts
    parts = table(d, "part").sort_values(["p_size", "p_partkey"])
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    for joined in ("true", "false"):  # one range, several ranges
        spark.conf.set(conf, joined)
        try:
            got = run("wn04_natural_order", spark, d)
        finally:
            spark.conf.unset(conf)
        assert list(got.sort_values("pos")["p_partkey"]) == list(parts["p_partkey"])
        assert sorted(got["pos"]) == list(range(1, len(parts) + 1))


def test_chunks_of_the_last_editions(spark, small):
    d = small.replace("sf0.001", "sf0.01")  # ids of the smallest tables end before 2022-06-01
    units = run("co15_parse", spark, d)
    last = {act: str((pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(n))).date()) for act, n in units.groupby("act")["edition"].max().items()}
    got = run("co17_chunks", spark, d)
    assert got.groupby("act")["edition"].agg(set).to_dict() == {act: {day} for act, day in last.items()}
