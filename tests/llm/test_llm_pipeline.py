"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from test_llm_operators import _components

from tidemark.session import landed


def test_stages_and_run(spark, docs, small):
    frame, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = landed(stage(spark, frame, small), name)
        kept[name] = frame
        if name != "bpe":
            assert frame.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda name: {r["doc_id"] for r in kept[name].select("doc_id").collect()}
    with_letters = {i for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    assert ids("language_id") <= with_letters and len(with_letters - ids("language_id")) <= 2
    first: dict = {}
    for i in sorted(ids("language_id")):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert ids("exact_dedup") == set(first.values())
    parts = _components([(i, rows[i]) for i in ids("exact_dedup")], 5, 80)
    assert ids("near_dedup") == set(parts.values())
    assert ids("mixing") == ids("near_dedup") and ids("bpe") == ids("mixing")
    assert kept["bpe"].count() == kept["mixing"].count()
    assert corpus_pipeline.run(spark, small).count() == kept["bpe"].count()


def test_pipeline_on_odd_rows(spark, odd):
    frame = odd
    for _, stage in corpus_pipeline.STAGES:
        frame = landed(stage(spark, frame, ""), "odd")
        if "ids" not in frame.columns:  # columns named like an operator's results are handed on as they came
            assert frame.columns == odd.columns and {r["score"] for r in frame.select("score").collect()} == {0.5}
    assert frame.where("doc_id = 1").count() >= 1 and frame.where("doc_id IN (3, 4, 5)").count() == 0
    frame = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = landed(stage(spark, frame, ""), "odd")
    assert frame.count() == 0
