"""Pinned cases of operators on literal rows."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import values as va
from tidemark.operators import changes, context, corpus, paths, quality, retrieval, temporal
from tidemark.operators.retrieval import SearchConfig
from tidemark.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scope_counts_both_ends(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01', DATE'2020-01-31'), (2, DATE'2020-02-01', NULL), (3, DATE'2020-01-31', DATE'2020-01-31') t(id, in_force_from, in_force_to)")
    assert [r["id"] for r in temporal.scope(df, "2020-01-31").orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in temporal.scope(df, "2020-02-01").collect()] == [2]


def test_prefix_is_not_a_substring(spark):
    df = spark.createDataFrame([("ст.21",), ("ст.21/п.1",), ("ст.210",), ("ст.21-1",)], "p string")
    assert [r["p"] for r in df.where(paths.under(F.col("p"), "ст.21")).collect()] == ["ст.21", "ст.21/п.1"]


def test_fusion_uses_weights_and_breaks_ties_by_channel(spark):
    hits = spark.createDataFrame([("a", "dense", 2), ("b", "fts", 1), ("c", "dense", 1), ("b", "lemma", 1), ("d", "other", 60)], "id string, channel string, rank int")
    out = [r["id"] for r in retrieval.rrf(hits, ["id"], SearchConfig(), ["dense", "fts", "lemma"]).collect()]
    assert out == ["c", "a", "b", "d"]
    equal = retrieval.rrf(hits, ["id"], SearchConfig(weights={}), ["dense", "fts", "lemma"]).collect()
    assert equal[0]["id"] == "b" and equal[0]["channels"] == {"fts": 1, "lemma": 1}


def test_hybrid_names_a_lost_channel(spark):
    good = lambda: spark.createDataFrame([("a", "dense", 1)], "id string, channel string, rank int")

    def bad():
        raise RuntimeError

    fused, meta = retrieval.hybrid({"dense": good, "fts": bad}, ["id"], SearchConfig(), ["dense", "fts"])
    assert fused.count() == 1 and meta["degraded"] == ["fts"] and meta["channels_run"] == ["dense"]


def test_websearch_match(spark):
    df = spark.createDataFrame([(1, "a b c".split()), (2, "b a".split()), (3, "c".split()), (4, [])], "id int, t array<string>")
    find = lambda q: [r["id"] for r in df.where(retrieval.match(F.col("t"), q)).orderBy("id").collect()]
    assert find("a b") == [1, 2] and find('"a b"') == [1] and find("a -c") == [2] and find('"a b" or c') == [1, 3] and find("") == []


def test_match_makes_tokens_once(spark):
    """However many places and clauses a query looks at, a document's tokens are made once."""
    df = spark.createDataFrame([(1, "x " * 50 + "a b c"), (2, "b a " * 20 + "a"), (3, None), (4, "")], "id int, text string")
    got = df.select("id", *[retrieval.match(tx.words(F.col("text")), q).alias(n) for n, q in (("hit", '"a b c" -z or "a a"'), ("bare", '-"a b"'))])
    assert sorted(map(tuple, got.collect())) == [(1, True, False), (2, True, False), (3, None, None), (4, False, True)]
    for q in ('"a b c"', "a b -c"):
        found = df.where(retrieval.match(tx.words(F.col("text")), q))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    holes = spark.createDataFrame([(1, ["a", None, "b"]), (2, [None, "a", "b"])], "id int, t array<string>")
    assert [r["hit"] for r in holes.orderBy("id").select(retrieval.match(F.col("t"), '"a b"').alias("hit")).collect()] == [False, True]


def _brute(queries, base, k):
    """Plain Python: by distance to 6 digits and id; undefined distances after all others, null ones last."""
    out = []
    for qid, q in queries:
        every = []
        for i, v in base:
            if q is None or v is None:
                every.append(((9, i), None))
                continue
            n = (sum(x * x for x in q) * sum(x * x for x in v)) ** 0.5
            d = round(1 - sum(x * y for x, y in zip(q, v)) / n, 6) + 0.0 if n else float("nan")
            every.append(((d if n else 8, i), d))
        out += [(qid, i, str(d)) for (_, i), d in sorted(every, key=lambda x: x[0])[:k]]
    return sorted(out)


def test_knn_join_of_odd_vectors_in_groups(spark):
    """Copies, vectors of length 0 and null ones; more rows than a tile and fewer than k; each task gives k rows a query."""
    vector = lambda i: None if i % 13 == 5 else [0.0, 0.0] if i % 11 == 3 else [float(i % 7 - 3), float(i % 5 + 1)]
    rows = [(i, vector(i)) for i in range(120)]
    base = spark.createDataFrame(rows[::-1], "id long, v array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:20], "qid long, q array<float>")
    for k, group in ((11, 65_536), (11, 7), (119, 65_536)):
        got = sorted((r["qid"], r["id"], str(r["dist"])) for r in retrieval.knn_join(queries, base, k, group).collect())
        assert got == _brute(rows[:20], rows, k)
    none = retrieval.knn_join(spark.createDataFrame([(1, None)], "qid long, q array<float>"), base, 3).collect()
    assert [(r["id"], r["dist"]) for r in none] == [(0, None), (1, None), (2, None)]
    assert retrieval.knn_join(queries.where("qid < 0"), base, 3).count() == 0
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [r["id"] for r in retrieval.knn_join(spark.createDataFrame([(1, [1.0, 0.0])], "qid int, q array<float>"), names, 2).orderBy("rank").collect()] == ["a", "b"]


def test_nearest_holds_tiles_not_all_pairs():
    """8,000 queries against 4 x 2,000 vectors: a matrix of all queries and one batch alone would take 128 MB."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((8_000, 16)).astype("f4")
    v[::9] = v[5]
    none = np.zeros(8_000, bool)
    tracemalloc.start()
    best = retrieval._Nearest(v, none, 11, np.dtype("int64"))
    for at in range(0, 8_000, 2_000):
        best.add(np.arange(at, at + 2_000)[::-1], v[at : at + 2_000][::-1], none[:2_000])
    assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()
    q, ids, dist, _ = best.found()
    assert len(q) == 8_000 * 11
    u = v.astype("f8") / np.linalg.norm(v.astype("f8"), axis=1, keepdims=True)
    for i in (0, 5, 4_000, 7_999):
        d = np.round(1 - u[i] @ u.T, 6) + 0.0
        want = np.lexsort((np.arange(8_000), d))[:11]
        assert ids[q == i].tolist() == want.tolist() and dist[q == i].tolist() == d[want].tolist()


def test_nearest_holds_bytes_not_rows(spark, monkeypatch):
    """Vectors of 1,024 numbers, a third of them copies: 16,384 pairs measured at once would take 268 MB."""
    import tracemalloc

    import numpy as np

    v = np.random.default_rng(2).standard_normal((1_000, 1_024)).astype("f4")
    v[::3] = v[5]
    none = np.zeros(1_000, bool)
    tracemalloc.start()
    best = retrieval._Nearest(v, none, 11, np.dtype("int64"))
    for at in range(0, 4_000, 1_000):
        best.add(np.arange(at, at + 1_000), v, none)
    assert tracemalloc.get_traced_memory()[1] < 96e6
    tracemalloc.stop()
    q, ids, dist, _ = best.found()
    assert ids[q == 0].tolist() == sorted([5, *range(0, 30, 3)])
    assert ids[q == 1].tolist()[:4] == [1, 1_001, 2_001, 3_001] and dist[q == 1].tolist()[:4] == [0.0] * 4

    rows = [(i, [float(i % 7 - 3), float(i % 5 + 1)]) for i in range(60)]
    base, queries = spark.createDataFrame(rows, "id long, v array<float>"), spark.createDataFrame(rows[:20], "qid long, q array<float>")
    monkeypatch.setattr(retrieval, "GROUP", 7 * (8 * 2 + 24 * 3))
    got = retrieval.knn_join(queries, base, 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    assert sorted((r["qid"], r["id"], str(r["dist"])) for r in got.collect()) == _brute(rows[:20], rows, 3)


def test_nearest_measures_few_of_many_copies(monkeypatch):
    """Of copies, vectors of length 0 and null ones, k of each tile can be among the best; all pairs would be 4,000,000."""
    import numpy as np

    rng = np.random.default_rng(3)
    v, none = rng.standard_normal((2_000, 4)).astype("f4"), np.arange(2_000) % 10 == 1
    v[np.arange(2_000) % 10 > 3] = v[4]
    v[none | (np.arange(2_000) % 10 == 2)] = 0
    measured, merge = [], retrieval._Nearest._merge
    monkeypatch.setattr(retrieval._Nearest, "_merge", lambda self, rows, dist, ids: measured.append(len(rows)) or merge(self, rows, dist, ids))
    best = retrieval._Nearest(v, none, 11, np.dtype("int64"))
    ids = np.arange(2_000)[::-1]
    best.add(ids, v[::-1], none[::-1])
    assert sum(measured) < 100_000
    q, found, dist, null = best.found()
    assert found[q == 1].tolist() == [*range(11)] and null[q == 1].all()
    assert found[q == 2].tolist() == [i for i in range(20) if i % 10 != 1][:11] and np.isnan(dist[q == 2]).all()
    assert found[q == 4].tolist() == found[q == 1_999].tolist() == [i for i in range(30) if i % 10 > 3][:11]


def test_cover_density_prefers_close_words(spark):
    df = spark.createDataFrame([(1, "x a b y".split()), (2, "a x x x b".split()), (3, "a b a b".split()), (4, "a".split())], "id int, t array<string>")
    s = {r["id"]: r["s"] for r in df.select("id", retrieval.cover_density(F.col("t"), ["a", "b"]).alias("s")).collect()}
    assert s[3] > s[1] > s[2] > s[4] == 0


def test_natural_order_before_the_cap(spark):
    df = spark.createDataFrame([(f"ст.1/п.{i}",) for i in (10, 2, 1)], "p string")
    assert [r["p"] for r in df.orderBy(tx.natural_key(F.col("p"))).collect()] == ["ст.1/п.1", "ст.1/п.2", "ст.1/п.10"]


def test_dedup_groups_by_act_and_article(spark):
    hits = spark.createDataFrame(
        [(1, 1, "A", "ст.5/п.2"), (1, 2, "B", "ст.5"), (1, 3, "A", "ст.5"), (1, 4, "A", "ст.7/п.10"), (1, 5, "A", "ст.7/п.9"), (1, 6, "B", "ст.5/п.1")], "qid int, rank int, act string, unit_path string"
    )
    out = [(r["act"], r["unit_path"]) for r in context.dedup_candidates(hits).orderBy("pos").collect()]
    assert out == [("A", "ст.5/п.2"), ("B", "ст.5"), ("A", "ст.7/п.9"), ("A", "ст.7/п.10")]


def test_budget(spark):
    def kept(sizes):
        df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "q int, i int, n int")
        return [r["n"] for r in context.budget(df, ["q"], ["i"], "n", 10_000).orderBy("i").collect()]

    assert kept([4000, 4000, 4000]) == [4000, 4000] and kept([99_999]) == [99_999] and kept([5000, 5000, 1]) == [5000, 5000]
    assert kept([6000, 6000, 1000]) == [6000] and kept([None, 10_000]) == [None, 10_000]


def test_gate(spark):
    cands = spark.createDataFrame([(1, "C1"), (1, "C2"), (2, "C1")], "q int, cid string")
    cited = spark.createDataFrame([(1, "C1"), (1, "C1"), (2, "C2"), (2, "C1")], "q int, cid string")
    out = {r["q"]: r for r in context.gate(cited, cands, ["q"]).collect()}
    assert out[1]["accepted"] and out[1]["resolved"] == ["C1"] and not out[2]["accepted"] and out[2]["invalid"] == ["C2"]


def test_lint(spark):
    df = spark.createDataFrame([("Надані кандидати, ст. 5 і C2", "статті 9", "ст. 5")], "p string, a string, r string")
    out = df.select(*[c.alias(n) for n, c in context.lint(F.concat_ws(" ", "p", "a"), F.col("a"), F.col("r")).items()]).first()
    assert out["prose_refs_unbacked"] == ["9"] and out["leaked_cids"] == ["C2"] and out["diyi_refs_unbacked"] == ["9"] and out["prose_internal_vocab"] == ["cid", "кандидат"]


def test_null_signal_is_no_baseline(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "a"), (1, 4, "b")], "s int, t int, g string")
    assert [r["changed"] for r in changes.with_changes(log, "s", ["t"], "g").orderBy("t").collect()] == [False, False, False, True]


def test_ledger_flags_loss_growth_and_new(spark):
    a = spark.createDataFrame([("k1", 5), ("k2", 5), ("k3", 5)], "k string, n int")
    b = spark.createDataFrame([("k1", 5), ("k2", 7), ("k4", 1)], "k string, n int")
    assert {r["k"]: r["status"] for r in changes.ledger_diff(a, b, ["k"], "n").collect()} == {"k2": "changed_or_deleted", "k3": "changed_or_deleted", "k4": "new"}


def test_metrics_and_taxonomy(spark):
    hits = spark.createDataFrame([("x", 1), ("x", 4), ("x", None), ("x", 11)], "c string, hit_rank int")
    m = quality.retrieval_metrics(hits, "c", 10).first()
    assert (m["n"], m["recall"], m["p1"], m["mrr"]) == (4, 0.5, 0.25, 0.3125)
    a = spark.createDataFrame([(["a"], ["a"], True, ["1"])], "g array<string>, c array<string>, x boolean, u array<string>")
    t = a.select(*[c.alias(n) for n, c in quality.taxonomy(F.col("g"), F.col("c"), F.col("x"), F.col("u")).items()]).first()
    assert t["correct"] == t["null"] == t["wrong_pick"] == [] and t["drift"] is False


def test_citations(spark):
    data = [("ст.23/п.1", None, "ст. 23 ч. 1"), ("розд.IV/п.2", None, "розд. IV п. 2"), ("затв.1/п.3", "ПОРЯДОК", "ПОРЯДОК (затв. 1) п. 3"), ("затв.2", None, "затв. 2"), ("преамбула/п.1", None, "преамбула п. 1"), ("дод.2/розд.I", None, "додаток 2 розд. I")]
    df = spark.createDataFrame([(p, b) for p, b, _ in data], "p string, b string")
    out = [r[0] for r in df.select(tx.citation(F.col("p"), F.lit("2026-04-12").cast("date"), F.col("b"))).collect()]
    assert out == [f"{c} · ред. від 12.04.2026" for _, _, c in data]


def test_parse_edition():
    text = "ЗАКОН\nПро щось\n1. Перше.\nРозділ I. ЗАГАЛЬНІ\nСтаття 15. Назва\n1. Частина.\n2. Друга {Частина друга із змінами}\nСтаття 151. Вставлена\nтекст\n{Статтю 16 виключено\nСтаття 99. Ні}\nСтаття 17. «цитата\nСтаття 18. у лапках\n»\nРозділ ХІ1\nкінець\nДодаток 2\nПЕРЕЛІК\n1. Один"
    units = {u.path: u for u in corpus.parse_edition(text)}
    assert {"преамбула", "преамбула/п.1", "розд.I", "ст.15", "ст.15/п.1", "ст.15/п.2", "ст.15-1", "ст.17", "розд.XI-1", "дод.2", "дод.2/п.1"} == set(units)
    assert units["ст.15/п.2"].markers == ["{Частина друга із змінами}"] and "{" not in units["ст.15/п.2"].text
    assert units["ст.15"].text.startswith("Стаття 15. Назва") and units["дод.2"].title == "ПЕРЕЛІК"
    assert corpus.parse_edition(None) == [] and [u.path for u in corpus.parse_edition("Стаття 1. а\nб\nСтаття 1. в")] == ["ст.1", "ст.1~2"]


def test_chunks_and_verify(spark):
    long = "довгий " * 10
    units = spark.createDataFrame(
        [("a", "2020-01-01", "ст.1", "article", "старе", None, 5), ("a", "2021-01-01", "ст.1", "article", "нове", None, 5), ("a", "2021-01-01", "ст.2", "article", long, None, 9000),
         ("a", "2021-01-01", "ст.2/п.1", "point", "частина", None, 5), ("a", "2021-01-01", "ст.3", "article", long, None, 9000), ("a", "2021-01-01", "ст.4", "article", "Назва", "Назва", 2), ("a", "2030-01-01", "ст.1", "article", "майбутнє", None, 5)],
        "act string, edition string, unit_path string, kind string, text string, title string, n_tokens int",
    ).withColumn("edition", F.col("edition").cast("date"))
    built = corpus.build_chunks(units, "2022-01-01")
    assert {r["unit_path"]: r["route"] for r in built.collect()} == {"ст.1": "chunk", "ст.2": "children", "ст.2/п.1": "chunk", "ст.3": "fail", "ст.4": "ineligible"}
    counters = {r["name"]: r["value"] for r in corpus.verify(built.where("route = 'chunk'"), units).collect()}
    assert counters.pop("chunks") == 2 and counters.pop("acts") == 1 and set(counters.values()) == {0}


def test_collapsed_numbers_need_a_twin(spark):
    units = spark.createDataFrame([("a", "ст.15"), ("a", "ст.16"), ("a", "ст.15-1"), ("a", "ст.1510"), ("a", "ст.15-10"), ("a", "ст.1699")], "act string, unit_path string")
    assert sorted(r["unit_path"] for r in corpus.split_collapsed(units).collect()) == sorted(["ст.15", "ст.16", "ст.15-1", "ст.15-10", "ст.15-10", "ст.1699"])


def test_values(spark):
    out = spark.sql("SELECT '20260230' a, '20240229' b, timestamp'2024-01-08 11:59:59' x, timestamp'2024-01-01 12:00:00' y").select(va.compact_date(F.col("a")), va.compact_date(F.col("b")).cast("string"), va.elapsed_days(F.col("x"), F.col("y"))).first()
    assert tuple(out) == (None, "2024-02-29", 6)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 3}\n')
    assert rows(files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int")) == [(1, 1), (3, 3)]
    (tmp_path / "b.txt").write_bytes("Стаття".encode("cp1251"))
    assert files.read_texts(spark, f"file://{tmp_path}/b.txt").first()["text"] == "Стаття"
    page = spark.createDataFrame([(1, "<h2>Q<br>1</h2><p>A <b>b</b></p><script>x</script><h2>Q2</h2>")], "id int, html string")
    assert [(r["question"], r["answer"]) for r in files.page_pairs(page, "id", "html").orderBy("pos").collect()] == [("Q1", "A b"), ("Q2", "")]
    html = files.answer_html(spark.createDataFrame([(1, "<q>", "see C1, x;", ["a&b"], ["c"])], "id int, question string, conclusion string, actions array<string>, citations array<string>")).first()["html"]
    assert "<q>" not in html and "C1" not in html and "a&amp;b" in html
