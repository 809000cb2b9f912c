"""Text, vector, fusion and quality queries over the driver's tables, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import values as va
from tidemark.operators import context, quality, retrieval
from tidemark.operators.retrieval import SearchConfig
from tidemark.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}
CONFIG = SearchConfig()
QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_DIST = f"round(1 - list_dot_product(embedding::DOUBLE[], {_Q}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({_Q}, {_Q})), 6) + 0.0"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dense(spark, d, k=50):
    return retrieval.knn(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", QUERY, k, "doc_id").select("doc_id", "dist")


def _keyword(spark, d, k=50):
    """Documents with both words, by how often they have them."""
    docs = load(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("t"))
    n = F.size(F.filter("t", lambda x: x.isin("the", "of")))
    return docs.where(retrieval.match(F.col("t"), "the of")).select("doc_id", n.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(k)


def _channels(spark, d):
    dense = retrieval.ranked(_dense(spark, d), "dense", F.col("dist"), "doc_id").select("doc_id", "channel", "rank")
    return dense.unionByName(retrieval.ranked(_keyword(spark, d), "fts", F.desc("hits"), "doc_id").select("doc_id", "channel", "rank"))


_CHANNELS = f"""WITH dense AS (SELECT doc_id, row_number() OVER (ORDER BY dist, doc_id) AS rank, 'dense' AS channel FROM (SELECT vec_id AS doc_id, {_DIST} AS dist FROM embeddings ORDER BY 2, 1 LIMIT 50)),
tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), fts0 AS (SELECT doc_id, len(list_filter(t, lambda x: x IN ('the', 'of'))) AS hits FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'of') ORDER BY 2 DESC, 1 LIMIT 50),
fts AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank, 'fts' AS channel FROM fts0), every AS (SELECT * FROM dense UNION ALL SELECT * FROM fts) """


@query(_CHANNELS + "SELECT doc_id, round(sum(CASE channel WHEN 'dense' THEN 2.0 ELSE 0.5 END / (60 + rank)), 8) AS rrf_score FROM every GROUP BY 1")
def ag08_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rrf(_channels(spark, d), ["doc_id"], CONFIG, ["dense", "fts"]).select("doc_id", "rrf_score")


@query(_CHANNELS + ", f AS (SELECT doc_id, round(sum(CASE channel WHEN 'dense' THEN 2.0 ELSE 0.5 END / (60 + rank)), 8) AS rrf_score, min((CASE channel WHEN 'dense' THEN 0 ELSE 1 END) * 1000 + rank) AS first FROM every GROUP BY 1) SELECT doc_id, rrf_score FROM f ORDER BY rrf_score DESC, first, doc_id LIMIT 10")
def co05_hybrid(spark, d):
    return retrieval.rrf(_channels(spark, d), ["doc_id"], CONFIG, ["dense", "fts"]).limit(10).select("doc_id", "rrf_score")


@query(f"SELECT vec_id AS doc_id, {_DIST} AS dist FROM embeddings ORDER BY 2, 1 LIMIT 10")
def tk01_knn(spark, d):
    return _dense(spark, d, 10)


_PAIR = "round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) + 0.0"
_KNN = f"WITH k AS (SELECT a.vec_id AS qid, a.label AS qlabel, b.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIR}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 7) "


def _ranked(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 7").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    k = retrieval.knn_join(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 11).where("qid <> id")
    from pyspark.sql import Window

    k = k.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), "id"))).where("rank <= 10")
    labels = e.select("vec_id", "label")
    return k.join(labels.withColumnsRenamed({"vec_id": "id"}), "id").join(labels.withColumnsRenamed({"vec_id": "qid", "label": "qlabel"}), "qid")


@query(_KNN + "SELECT qid, qlabel, min(CASE WHEN label = qlabel THEN rank END) AS hit_rank FROM k WHERE rank <= 10 GROUP BY 1, 2")
def jn16_gold_rank(spark, d):
    return quality.first_hit(_ranked(spark, d), ["qid", "qlabel"], F.col("label") == F.col("qlabel"))


@query(_KNN + """, h AS (SELECT qid, qlabel, min(CASE WHEN label = qlabel THEN rank END) AS r FROM k WHERE rank <= 10 GROUP BY 1, 2)
SELECT qlabel, count(*) AS n, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS p1, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr FROM h GROUP BY 1""")
def ag09_metrics(spark, d):
    return quality.retrieval_metrics(quality.first_hit(_ranked(spark, d), ["qid", "qlabel"], F.col("label") == F.col("qlabel")), "qlabel", 10)


@query(_KNN + """, b AS (SELECT qid, min(CASE WHEN label = qlabel THEN rank END) AS base_rank FROM k WHERE rank <= 10 GROUP BY 1), n AS (SELECT qid, min(CASE WHEN label = qlabel AND id % 2 = 0 THEN rank END) AS now_rank FROM k WHERE rank <= 10 GROUP BY 1)
SELECT qid, base_rank, now_rank, CASE WHEN base_rank IS NOT NULL AND now_rank IS NULL THEN 'lost' WHEN base_rank IS NULL AND now_rank IS NOT NULL THEN 'gained' WHEN base_rank IS DISTINCT FROM now_rank THEN 'moved' ELSE 'same' END AS state FROM b LEFT JOIN n USING (qid)""")
def jn14_baseline(spark, d):
    r = _ranked(spark, d)
    hit = F.col("label") == F.col("qlabel")
    return quality.baseline_compare(quality.first_hit(r, ["qid"], hit), quality.first_hit(r, ["qid"], hit & (F.col("id") % 2 == 0)), "qid")


@query(_CHANNELS + """, x AS (SELECT doc_id, rank FROM fts WHERE rank <= 12), c AS (SELECT doc_id, row_number() OVER (ORDER BY rank, doc_id) AS rank FROM dense WHERE doc_id NOT IN (SELECT doc_id FROM x)),
m AS (SELECT doc_id, rank, 0 AS part, 'exact' AS route FROM x WHERE rank <= greatest(1, 10 - least(2, (SELECT count(*) FROM c))) UNION ALL SELECT doc_id, rank, 1, 'channel' FROM c), p AS (SELECT doc_id, route, row_number() OVER (ORDER BY part, rank, doc_id) AS pos FROM m) SELECT * FROM p WHERE pos <= 10""")
def tk06_reserve_merge(spark, d):
    ch = _channels(spark, d)
    return retrieval.merge_with_reserve(ch.where("channel = 'fts' AND rank <= 12").select("doc_id", "rank"), ch.where("channel = 'dense'").select("doc_id", "rank"), "doc_id", 10, CONFIG)


@query("""SELECT vec_id, round(sqrt(list_dot_product(n, n)), 9) AS norm, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS n FROM embeddings)""")
def ma01_l2(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", va.l2_normalise(F.col("embedding")).alias("n"))
    return e.select("vec_id", F.round(F.sqrt(va.dot(F.col("n"), F.col("n"))), 9).alias("norm"), F.round(F.get("n", F.lit(0)), 6).alias("first"))


@query(r"""SELECT doc_id, trim(regexp_replace(translate(translate(lower(text), '«»"“”„‹›', '        '), '’`´ʼ', ''''''''''), '\s+', ' ', 'g')) AS norm FROM documents""")
def fn01_norm(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.norm(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, len(regexp_extract_all('{' || lang || ' x}' || text || '{a', '\{[^{}]*\}')) AS n FROM documents")
def fn04_markers(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tx.markers(F.concat(F.lit("{"), "lang", F.lit(" x}"), "text", F.lit("{a")))).cast("long").alias("n"))


@query(r"""WITH q(id, t) AS (VALUES (1, 'Стаття 210-1 та ст. 5'), (2, 'СТАТТІ 23, ст.7-2'), (3, 'без номера')) SELECT id, array_to_string(regexp_extract_all(t, '(?i)(?:статт[\p{L}\p{N}_]*|ст)\.?\s*(\d+(?:-\d+)?)', 1), ',') AS refs FROM q""")
def fn05_article_refs(spark, d):
    q = spark.createDataFrame([(1, "Стаття 210-1 та ст. 5"), (2, "СТАТТІ 23, ст.7-2"), (3, "без номера")], "id int, t string")
    return q.select("id", F.array_join(tx.article_refs(F.col("t")), ",").alias("refs"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body,
substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), 1, 16) AS signal FROM pages""")
def fn07_html_text(spark, d):
    return load(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("body")).withColumn("signal", tx.short_hash(F.col("body")))


@query(f"SELECT doc_id, len({_TOKENS}) AS n FROM documents")
def fn08_words(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n"))


@query(f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'of')")
def fn10_match(spark, d):
    return load(spark, d, "documents").where(retrieval.match(tx.words(F.col("text")), "the and -of")).select("doc_id")


@query(f"WITH t AS (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS t FROM documents) SELECT doc_id FROM t WHERE contains(t, ' of the ')")
def fn10_phrase(spark, d):
    return load(spark, d, "documents").where(retrieval.match(tx.words(F.col("text")), '"of the"')).select("doc_id")


@query()
def fn11_cover_density(spark, d):
    docs = load(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("t")).where(retrieval.match(F.col("t"), "the of"))
    return docs.select("doc_id", F.round(retrieval.cover_density(F.col("t"), ["the", "of"]), 6).alias("rank")).orderBy(F.desc("rank"), "doc_id").limit(50)


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(t, '\bC\d+\b', '', 'g'), '\s{2,}', ' ', 'g'), ' ,;') AS shown FROM (VALUES (1, 'see C1, C2  and x;'), (2, ' ,none'), (3, 'CC1 stays')) q(id, t)""")
def fn18_prose(spark, d):
    q = spark.createDataFrame([(1, "see C1, C2  and x;"), (2, " ,none"), (3, "CC1 stays")], "id int, t string")
    return q.select("id", tx.prose(F.col("t")).alias("shown"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url || '<&\"''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def fn20_escape(spark, d):
    return load(spark, d, "pages").select("page_id", tx.html_escape(F.concat("url", F.lit("<&\"'>"))).alias("safe"))


@query("SELECT p_partkey, trim(x) AS piece FROM (SELECT p_partkey, unnest(string_split(p_name || ', ,z', ' ')) AS x FROM part) WHERE trim(x) <> ''")
def fn21_split_explode(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(", ,z")), " ")).alias("x"))
    return p.select("p_partkey", F.trim("x").alias("piece")).where("piece <> ''")


@query("""WITH t(id, v) AS (VALUES (1, '20240229'), (2, '20260230'), (3, '2024'), (4, 'abcdefgh')) SELECT id, CASE WHEN regexp_matches(v, '^\\d{8}$') THEN CAST(CAST(try_strptime(v, '%Y%m%d') AS DATE) AS VARCHAR) END AS day FROM t""")
def dt01_compact_date(spark, d):
    t = spark.createDataFrame([(1, "20240229"), (2, "20260230"), (3, "2024"), (4, "abcdefgh")], "id int, v string")
    return t.select("id", va.compact_date(F.col("v")).cast("string").alias("day"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y') AS day FROM events")
def dt02_format(spark, d):
    return load(spark, d, "events").select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("day"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def js01_json(spark, d):
    return load(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations), s AS (SELECT *, 'ст.' || (turn // 3) AS stem, CASE WHEN turn % 3 = 0 THEN 'ст.' || (turn // 3) ELSE 'ст.' || (turn // 3) || '/п.' || turn END AS unit_path FROM h),
g AS (SELECT *, max(CASE WHEN unit_path = stem THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, stem) AS box, min(rank) OVER (PARTITION BY conv_id, stem) AS best FROM s)
SELECT conv_id, unit_path, rank, row_number() OVER (PARTITION BY conv_id ORDER BY best, turn, rank) AS pos FROM g WHERE box = 0 OR rank = best""")
def co11_dedup(spark, d):
    from pyspark.sql import Window

    c = load(spark, d, "conversations")
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")))
    s = F.concat(F.lit("ст."), F.floor(F.col("turn") / 3))
    hits = c.select("conv_id", "rank", F.lit("a").alias("act"), F.when(F.col("turn") % 3 == 0, s).otherwise(F.concat(s, F.lit("/п."), "turn")).alias("unit_path"))
    return context.dedup_candidates(hits, "conv_id").select("conv_id", "unit_path", "rank", "pos")


_CAND = "WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), s AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r), o AS (SELECT *, max(CASE WHEN used > 10000 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) AS over_ FROM s), k AS (SELECT doc_id, source, 'C' || rank AS cid FROM o WHERE over_ = 0) "


def _candidates(spark, d):
    kept = context.budget(load(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 10_000)
    return context.candidate_ids(kept, ["source"], ["doc_id"]).select("doc_id", "source", "cid")


@query(_CAND + "SELECT * FROM k")
def co11_candidates(spark, d):
    return _candidates(spark, d)


@query(_CAND + """, c AS (SELECT DISTINCT source, 'C' || (doc_id % 7) AS cid FROM documents WHERE doc_id % 3 = 0), j AS (SELECT c.source, c.cid, k.cid IS NOT NULL AS ok FROM c LEFT JOIN k ON k.source = c.source AND k.cid = c.cid)
SELECT source, coalesce(string_agg(CASE WHEN ok THEN cid END, ',' ORDER BY cid), '') AS resolved, coalesce(string_agg(CASE WHEN NOT ok THEN cid END, ',' ORDER BY cid), '') AS invalid, count(*) FILTER (WHERE NOT ok) = 0 AND count(*) FILTER (WHERE ok) > 0 AS accepted FROM j GROUP BY 1""")
def co12_gate(spark, d):
    cited = load(spark, d, "documents").where("doc_id % 3 = 0").select("source", F.concat(F.lit("C"), F.col("doc_id") % 7).alias("cid"))
    g = context.gate(cited, _candidates(spark, d), ["source"])
    return g.select("source", F.array_join("resolved", ",").alias("resolved"), F.array_join("invalid", ",").alias("invalid"), "accepted")


@query()
def co13_lint(spark, d):
    q = spark.createDataFrame([(1, "Надані кандидати: ст. 5 і C2", "див. ст. 9", "ст. 5 ч. 1"), (2, "статтею 7", "", "ст. 7")], "id int, prose string, actions string, resolved string")
    return q.select("id", *[F.array_join(c, ",").alias(n) for n, c in context.lint(F.concat_ws(" ", "prose", "actions"), F.col("actions"), F.col("resolved")).items()])


@query("""WITH a(id, gold, cited, abstain, unbacked) AS (VALUES (1, ['a', 'b'], ['b', 'c'], false, ['9']), (2, ['a'], ['a'], true, ['1']), (3, ['x'], []::VARCHAR[], false, []::VARCHAR[]))
SELECT id, CASE WHEN abstain THEN '' ELSE array_to_string(list_sort(list_filter(gold, lambda x: list_contains(cited, x))), ',') END AS correct, CASE WHEN abstain THEN '' ELSE array_to_string(list_sort(list_filter(gold, lambda x: NOT list_contains(cited, x))), ',') END AS "null",
CASE WHEN abstain THEN '' ELSE array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(gold, x))), ',') END AS wrong_pick, NOT abstain AND len(list_filter(gold, lambda x: list_contains(cited, x))) > 0 AND len(unbacked) > 0 AS drift FROM a""")
def co26_taxonomy(spark, d):
    a = spark.createDataFrame([(1, ["a", "b"], ["b", "c"], False, ["9"]), (2, ["a"], ["a"], True, ["1"]), (3, ["x"], [], False, [])], "id int, gold array<string>, cited array<string>, abstain boolean, unbacked array<string>")
    t = quality.taxonomy(F.col("gold"), F.col("cited"), F.col("abstain"), F.col("unbacked"))
    return a.select("id", *[(c if n == "drift" else F.array_join(c, ",")).alias(n) for n, c in t.items()])


@query("SELECT source, list_has_all(list(DISTINCT lang), ['en', 'fr']) AS sufficient FROM documents GROUP BY 1")
def ag11_sufficient(spark, d):
    g = load(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("have"))
    return g.select("source", quality.sufficient(F.array(F.lit("en"), F.lit("fr")), F.col("have")).alias("sufficient"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def co27_must_not_contain(spark, d):
    return quality.phrases_in(load(spark, d, "documents"), load(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")))


@query()
def fn12_citation(spark, d):
    rows = [(1, "ст.23/п.1", "2026-04-12", None), (2, "розд.IV/гл.5/п.2", "2026-04-12", None), (3, "затв.1/п.3", "2026-04-12", "ПОРЯДОК"), (4, "преамбула/п.1", "2026-04-12", None), (5, "дод.2/розд.I", "2026-04-12", None)]
    q = spark.createDataFrame(rows, "id int, path string, day string, block string")
    return q.select("id", tx.citation(F.col("path"), F.col("day").cast("date"), F.col("block")).alias("citation"))
