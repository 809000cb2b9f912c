"""Further queries: gates, tallies, guarded hashes, updates, text shapes and the exact route."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import answers
from tidemark.session import load, ship

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, CAST(floor((epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(max(ts))) / 86400) AS BIGINT) AS days, floor((epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(max(ts))) / 86400) >= 11 AS due FROM events WHERE event_type = 'purchase' GROUP BY 1")
def wn10_due(spark, d):
    last = load(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    days = F.floor(F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")) / 86400)
    return last.select("user_id", days.alias("days"), (days >= 11).alias("due"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM s""")
def wn13_clamped_depth(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    s = load(spark, d, "events").withColumn("s", F.sum(x).over(w))
    return s.select("event_id", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("bigint").alias("depth"))


@query("SELECT reviewer, CAST(sum(flag) AS BIGINT) AS flags, count(DISTINCT CASE WHEN flag = 1 THEN doc_id END) AS items FROM (SELECT doc_id, 'quality' AS reviewer, quality AS flag FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) GROUP BY 1")
def ag16_tally(spark, d):
    t = load(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "reviewer", "flag")
    return t.groupBy("reviewer").agg(F.sum("flag").cast("bigint").alias("flags"), F.countDistinct(F.when(F.col("flag") == 1, F.col("doc_id"))).alias("items"))


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 5 THEN substr(sha256(string_agg(DISTINCT event_type, '|' ORDER BY event_type)), 1, 16) END AS signal FROM events GROUP BY 1")
def ag19_complete_hash(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return g.select("user_id", F.when(F.size("k") == 5, tx.short_hash(F.array_join(F.array_sort("k"), "|"))).alias("signal"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT a.o_custkey, a.n = b.n AND a.last = b.last AS same FROM a JOIN b USING (o_custkey)""")
def jn18_state_compare(spark, d):
    o = load(spark, d, "orders")
    state = lambda df, p: df.groupBy("o_custkey").agg(F.count("*").alias(f"n{p}"), F.to_date(F.max("o_orderdate")).alias(f"l{p}"))
    return state(o, "a").join(state(o.where("o_orderstatus <> 'P'"), "b"), "o_custkey").select("o_custkey", ((F.col("na") == F.col("nb")) & (F.col("la") == F.col("lb"))).alias("same"))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)href=.?/the|href=.?/der')")
def sk05_conditional_update_ids(spark, d):
    p = load(spark, d, "pages").withColumn("hit", F.col("html").rlike("(?iu)href=.?/the|href=.?/der")).withColumn("html", F.when(F.col("hit"), F.lit(None).cast("string")).otherwise(F.col("html")))
    return p.where("hit AND html IS NULL").select("page_id")


@query("SELECT p_partkey, CASE WHEN contains(p_name, p_brand) THEN p_name ELSE p_brand || ', ' || p_name END AS citation FROM part")
def fn13_act_citation(spark, d):
    return load(spark, d, "part").select("p_partkey", tx.act_citation(F.col("p_brand"), F.col("p_name")).alias("citation"))


@query("SELECT DISTINCT split_part('o' || l_orderkey || '/l' || l_linenumber, '/', 1) AS stem FROM lineitem")
def fn14_stem(spark, d):
    path = F.concat(F.lit("o"), "l_orderkey", F.lit("/l"), "l_linenumber")
    return load(spark, d, "lineitem").select(tx.stem(path).alias("stem")).distinct()


@query("""SELECT t, regexp_replace(CASE WHEN regexp_matches(t, '^[IVXLCDMІХСМ]+(-?[0-9]+)?$') THEN translate(t, 'ІХСМ', 'IXCM') ELSE t END, '^([IVXLCDM]+)-?([0-9]+)$', '\\1-\\2') AS n FROM (VALUES ('ХІ'), ('VI1'), ('VI-1'), ('13-А'), ('IX')) q(t)""")
def fn15_section_number(spark, d):
    return spark.createDataFrame([("ХІ",), ("VI1",), ("VI-1",), ("13-А",), ("IX",)], "t string").select("t", tx.section_number(F.col("t")).alias("n"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), '|') AS first3 FROM documents")
def ar01_slice(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 3), "|").alias("first3"))


@query("SELECT k AS name FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)")
def js01_object_keys(spark, d):
    return load(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("name")).distinct()


@query("""WITH recorded(t) AS (VALUES ('a'), ('b'), ('c')), ran(t) AS (VALUES ('b'), ('c'), ('d')) SELECT t, 'lost' AS state FROM (SELECT t FROM recorded EXCEPT SELECT t FROM ran) UNION ALL SELECT t, 'new' FROM (SELECT t FROM ran EXCEPT SELECT t FROM recorded)""")
def st05_ratchet(spark, d):
    a, b = (spark.createDataFrame([(x,) for x in s], "t string") for s in ("abc", "bcd"))
    return a.subtract(b).withColumn("state", F.lit("lost")).union(b.subtract(a).withColumn("state", F.lit("new")))


@query("SELECT id, CASE WHEN s = 200 AND ct = 'application/json' THEN 'GREEN' WHEN s = 200 THEN 'RED' WHEN s = 403 THEN 'YELLOW' WHEN s BETWEEN 300 AND 399 THEN 'RED' ELSE 'ERROR' END AS state FROM (VALUES (1, 200, 'application/json'), (2, 200, 'text/html'), (3, 403, ''), (4, 302, ''), (5, 500, '')) q(id, s, ct)")
def co23_reachability(spark, d):
    q = spark.createDataFrame([(1, 200, "application/json; charset=utf-8", ' {"a":1}'), (2, 200, "text/html", "<html>"), (3, 403, "", ""), (4, 302, "", ""), (5, 500, None, None)], "id int, s int, ct string, b string")
    return q.select("id", answers.reachability(F.col("s"), F.col("ct"), F.col("b")).alias("state"))


@query()
def co06_exact_lookup(spark, d):
    acts = spark.createDataFrame([("A-1", "Кодекс про працю громадян"), ("B-2", "Закон про освіту дітей")], "act string, title string")
    units = spark.createDataFrame([(a, f"ст.{s}" + (f"/п.{p}" if p else "")) for a in ("A-1", "B-2") for s in (5, 50, 7) for p in (0, 10, 2)], "act string, unit_path string")
    units = units.withColumn("in_force_from", F.lit("2020-01-01").cast("date")).withColumn("in_force_to", F.lit(None).cast("date"))
    q = spark.createDataFrame([(1, "Що каже ст. 5 кодексу про працю громадян і стаття 7 закону про освіту дітей?"), (2, "ст. 50"), (3, "B-2 ст. 50")], "qid int, q string")
    return answers.exact_lookup(q, acts, units, "2024-01-01").select("qid", "rank", "act", "unit_path")


@query()
def co09_embed(spark, d):
    ship(spark)
    return load(spark, d, "documents").select("doc_id", answers.hashed_embedding(F.concat(F.lit("passage: "), "text")).alias("v"))


@query()
def co08_rerank(spark, d):
    return answers.rerank(load(spark, d, "documents").select("doc_id", "text"), "the of and").select("doc_id", "rerank_score")


@query()
def sr03_rate_windows(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("host"), F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("t"), F.col("event_id").alias("id"))
    return answers.rate_windows(e, 3, 600)


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: CASE x WHEN 'was' THEN 'be' WHEN 'is' THEN 'be' WHEN 'are' THEN 'be' ELSE x END), ' ') AS lemmas FROM documents")
def fn09_lemmas(spark, d):
    """A small map stands for the dictionary."""
    table = F.create_map(*[F.lit(x) for pair in (("was", "be"), ("is", "be"), ("are", "be")) for x in pair])
    return load(spark, d, "documents").select("doc_id", F.array_join(answers.lemmas(tx.words(F.col("text")), table), " ").alias("lemmas"))
