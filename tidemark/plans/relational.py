"""Temporal, path, join, aggregation, set and window queries over the driver's tables, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import values as va
from tidemark.operators import changes, context, paths, quality, retrieval, temporal
from tidemark.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").alias("day"))


def _units(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("o"), "l_orderkey", F.lit("/l"), "l_linenumber").alias("unit_path"))
    return line.unionByName(line.select("l_orderkey", F.concat(F.lit("o"), "l_orderkey").alias("unit_path"))).distinct()


_UNITS = "WITH u AS (SELECT l_orderkey, 'o' || l_orderkey || '/l' || l_linenumber AS unit_path FROM lineitem UNION SELECT l_orderkey, 'o' || l_orderkey FROM lineitem) "


@query("SELECT c_custkey, c_name FROM customer")
def sc01_projection(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14)")
def sc02_keyed_scan(spark, d):
    return load(spark, d, "part").where(F.col("p_size").isin(1, 5, 9, 14)).select("p_partkey", "p_brand", "p_size")


@query("""WITH v AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS f, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) - 1 AS t FROM orders)
SELECT o_orderkey, o_custkey, CAST(f AS VARCHAR) AS in_force_from, CAST(t AS VARCHAR) AS in_force_to FROM v WHERE f <= DATE '1997-01-01' AND (t IS NULL OR t >= DATE '1997-01-01')""")
def pf01_scope_as_of(spark, d):
    v = temporal.scope(temporal.intervals(_orders(spark, d), "o_custkey", "day", "o_orderkey"), "1997-01-01")
    return v.select("o_orderkey", "o_custkey", F.col("in_force_from").cast("string").alias("in_force_from"), F.col("in_force_to").cast("string").alias("in_force_to"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= DATE '1998-06-30') WHERE rn = 1")
def jn04_latest_per_key(spark, d):
    return temporal.latest_per_key(_orders(spark, d).where(F.col("day") <= F.lit("1998-06-30").cast("date")), "o_custkey", ["day", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def tk04_latest_n(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("day"), F.desc("o_orderkey"))
    return _orders(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("""SELECT e.event_id, e.user_id, a.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) a ON e.user_id = a.user_id AND e.ts >= a.ts""")
def asof_join(spark, d):
    ev = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    right = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.as_of_join(ev.where("event_type = 'click'").select("event_id", "user_id", "ts"), right.withColumnRenamed("ts", "rts"), "user_id", "ts", "rts", ["value"]).select("event_id", "user_id", "asof_value")


@query(_UNITS + "SELECT * FROM u WHERE unit_path = 'o1' OR starts_with(unit_path, 'o1/')")
def pf03_prefix(spark, d):
    return _units(spark, d).where(paths.under(F.col("unit_path"), "o1"))


@query(_UNITS + "SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM u k WHERE k.l_orderkey = u.l_orderkey AND starts_with(k.unit_path, u.unit_path || '/'))")
def pf04_leaves(spark, d):
    return paths.leaves(_units(spark, d), ["l_orderkey"], "unit_path").select("l_orderkey", "unit_path")


@query(_UNITS + "SELECT u.*, EXISTS (SELECT 1 FROM u k WHERE k.l_orderkey = u.l_orderkey AND starts_with(k.unit_path, u.unit_path || '/')) AS has_kids FROM u")
def pf05_container(spark, d):
    return paths.containers(_units(spark, d), ["l_orderkey"], "unit_path").select("l_orderkey", "unit_path", "has_kids")


@query("SELECT doc_id FROM documents WHERE lower(text) IS DISTINCT FROM trim(text)")
def pf06_drift(spark, d):
    return load(spark, d, "documents").where(~F.lower("text").eqNullSafe(F.trim("text"))).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice IS NULL OR o_totalprice > 1000)")
def pf07_status_gate(spark, d):
    return _orders(spark, d).where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice").isNull() | (F.col("o_totalprice") > 1000))).select("o_orderkey", "o_orderstatus")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|copyright')")
def pf08_regex(spark, d):
    return load(spark, d, "documents").where(F.col("text").rlike("(?iu)license|copyright")).select("doc_id")


@query("SELECT page_id FROM pages WHERE url LIKE '%/%' AND contains(url, '1')")
def pf09_like(spark, d):
    return load(spark, d, "pages").where(F.col("url").like("%/%") & F.contains("url", F.lit("1"))).select("page_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_\-])the($|[^A-Za-z0-9_\-])')")
def pf10_token_boundary(spark, d):
    return load(spark, d, "documents").where(F.col("text").rlike(r"(?<![A-Za-z0-9_\-])the(?![A-Za-z0-9_\-])")).select("doc_id")


@query("""WITH m AS (SELECT doc_id, text, regexp_matches(lower(text), 'license|token|the') AS hit, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS seen FROM documents)
SELECT doc_id, hit FROM m WHERE seen = 1 ORDER BY hit DESC, doc_id LIMIT 42""")
def pf11_keyword_select(spark, d):
    docs = load(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return docs.withColumn("hit", F.lower("text").rlike("license|token|the")).orderBy(F.desc("hit"), "doc_id").limit(42).select("doc_id", "hit")


@query(r"SELECT page_id, length(html) >= 50 AND contains(lower(substr(html, 1, 2000)), '<nav') AND regexp_matches(html, 'h1>D') AS ok FROM pages")
def pf12_plausible(spark, d):
    return load(spark, d, "pages").select("page_id", ((F.length("html") >= 50) & F.contains(F.lower(F.substring("html", 1, 2000)), F.lit("<nav")) & F.col("html").rlike("h1>D")).alias("ok"))


@query("SELECT conv_id, turn, length(trim(text)) BETWEEN 1 AND 2000 AS valid FROM conversations")
def pf13_request_valid(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.length(F.trim("text")).between(1, 2000).alias("valid"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def pf14_content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT s.s_suppkey, coalesce(n.n_name, CAST(s.s_nationkey AS VARCHAR)) AS canon FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s.s_nationkey = n.n_nationkey")
def pf15_alias(spark, d):
    few = load(spark, d, "nation").where("n_regionkey < 3")
    return load(spark, d, "supplier").join(few, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("canon"))


@query("SELECT doc_id, n_chars > 0 AND n_chars <= 8192 AS ok FROM documents")
def pf16_checks(spark, d):
    return load(spark, d, "documents").select("doc_id", ((F.col("n_chars") > 0) & (F.col("n_chars") <= 8192)).alias("ok"))


@query("SELECT d.doc_id, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def jn01_inner(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label")


@query("SELECT DISTINCT sha256(text) AS h FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def jn05_missing_hash(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.select("h").distinct().join(docs.where("doc_id % 2 = 0"), "h", "left_anti")


@query("SELECT count(*) AS orphans FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn06_orphans(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def jn09_left_count(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""WITH a AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderdate < DATE '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderdate < DATE '1998-01-01' AND o_custkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS old, b.v AS new, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS status FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey""")
def jn12_diff(spark, d):
    o = _orders(spark, d)
    a = o.where(F.col("day") < F.lit("1997-01-01").cast("date")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    b = o.where((F.col("day") < F.lit("1998-01-01").cast("date")) & (F.col("o_custkey") % 7 != 0)).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v"))
    return changes.snapshot_diff(a, b, ["o_custkey"], "v")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS old, b.n AS new, CASE WHEN a.o_custkey IS NULL THEN 'new' ELSE 'changed_or_deleted' END AS status FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n""")
def jn13_ledger(spark, d):
    o = _orders(spark, d)
    a = o.where(F.col("day") < F.lit("1998-01-01").cast("date")).groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = o.where(F.col("o_custkey") % 5 != 0).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return changes.ledger_diff(a, b, ["o_custkey"], "n")


@query("""WITH m AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 20), r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey >= 3)
SELECT n_nationkey, 'missing' AS problem FROM m WHERE n_nationkey NOT IN (SELECT n_nationkey FROM r) UNION ALL SELECT n_nationkey, 'orphan' FROM r WHERE n_nationkey NOT IN (SELECT n_nationkey FROM m)
UNION ALL SELECT m.n_nationkey, 'drift:n_name' FROM m JOIN r USING (n_nationkey) WHERE m.n_name IS DISTINCT FROM r.n_name UNION ALL SELECT m.n_nationkey, 'drift:n_regionkey' FROM m JOIN r USING (n_nationkey) WHERE m.n_regionkey IS DISTINCT FROM r.n_regionkey""")
def jn15_coherence(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    other = n.where("n_nationkey >= 3").withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return changes.coherence(n.where("n_nationkey < 20"), other, "n_nationkey", ["n_name", "n_regionkey"])


_BIND = "WITH a(qid, apos, article) AS (VALUES (1, 0, '23'), (1, 20, '5'), (2, 30, '7'), (3, 40, '9'), (3, 50, '10')), m(qid, pos, act, len) AS (VALUES (1, 10, 'A', 8), (1, 30, 'B', 9), (1, 30, 'C', 5), (2, 3, 'D', 7), (3, 1, 'E', 6)) "


@query(_BIND + """, r AS (SELECT a.qid, apos, article, act, row_number() OVER (PARTITION BY a.qid, apos, article ORDER BY pos, len DESC, act) AS rn FROM a JOIN m ON a.qid = m.qid AND pos >= apos)
SELECT qid, apos, article, act FROM r WHERE rn = 1 UNION ALL SELECT a.qid, apos, article, (SELECT min(act) FROM m WHERE m.qid = a.qid) FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.qid = a.qid AND r.apos = a.apos)
AND (SELECT count(*) FROM a x WHERE x.qid = a.qid) = 1 AND (SELECT count(DISTINCT act) FROM m WHERE m.qid = a.qid) = 1""")
def jn17_nearest_right(spark, d):
    a = spark.createDataFrame([(1, 0, "23"), (1, 20, "5"), (2, 30, "7"), (3, 40, "9"), (3, 50, "10")], "qid int, apos int, article string")
    m = spark.createDataFrame([(1, 10, "A", 8), (1, 30, "B", 9), (1, 30, "C", 5), (2, 3, "D", 7), (3, 1, "E", 6)], "qid int, pos int, act string, len int")
    return retrieval.bind_citations(a, m)


@query("SELECT count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents")
def ag01_counts(spark, d):
    return load(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.countDistinct("lang").alias("langs"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, max(l_shipdate)::VARCHAR[:10] AS last FROM lineitem GROUP BY 1, 2".replace("max(l_shipdate)::VARCHAR[:10]", "CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR)"))
def ag03_group_counts(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.to_date(F.max("l_shipdate")).cast("string").alias("last"))


@query("SELECT count(*) AS collisions FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def ag05_collisions(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("collisions"))


@query("SELECT count(DISTINCT CASE WHEN l.doc_id IS NULL THEN d.doc_id END) AS missing, count(DISTINCT d.doc_id) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def ag07_coverage(spark, d):
    j = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return j.agg(F.countDistinct(F.when(F.col("has").isNull(), F.col("doc_id"))).alias("missing"), F.countDistinct("doc_id").alias("total"))


@query("SELECT coalesce(lang, 'all') AS lang, grouping(lang) AS g, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def ag10_score(spark, d):
    j = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    return j.rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("""SELECT count(*) AS n, round(avg(s), 6) AS set_flip_rate, CAST(sum(g) AS BIGINT) AS gold_flips FROM (SELECT user_id, CAST(count(DISTINCT event_type) > 1 AS INTEGER) AS s, CAST(count(DISTINCT event_type = 'click') > 1 AS INTEGER) AS g
FROM events GROUP BY 1)""")
def ag12_noise(spark, d):
    e = load(spark, d, "events").withColumn("hit", F.col("event_type") == "click")
    return quality.noise(e, "user_id", "event_type", "hit")


@query("""WITH t(run, code) AS (VALUES (1, 0), (1, 2), (2, 0), (2, 3), (3, 1), (3, 3), (4, 77), (4, 1), (5, 0)) SELECT run, arg_max(code, CASE code WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 ELSE 4 END) AS worst FROM t GROUP BY 1""")
def ag17_worst_code(spark, d):
    t = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 3), (3, 1), (3, 3), (4, 77), (4, 1), (5, 0)], "run int, code int")
    return t.groupBy("run").agg(F.max_by("code", va.severity(F.col("code"))).alias("worst"))


@query("SELECT user_id, substr(sha256(string_agg(DISTINCT event_type, '|' ORDER BY event_type)), 1, 16) AS set_hash FROM events GROUP BY 1")
def ag18_set_hash(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(changes.set_hash(F.col("event_type")).alias("set_hash"))


@query("""WITH v AS (SELECT DISTINCT p_brand, p_partkey FROM part), g AS (SELECT *, CASE WHEN p_partkey - lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) > 60 THEN 1 ELSE 0 END AS gap FROM v),
s AS (SELECT *, sum(gap) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS gaps FROM g) SELECT p_brand, max(p_partkey) AS cluster_max FROM s WHERE gaps = 0 GROUP BY 1""")
def ag20_dense_cluster(spark, d):
    return changes.dense_cluster_max(load(spark, d, "part"), "p_brand", "p_partkey", 60)


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1".replace("list_sort(list(DISTINCT event_type))", "string_agg(DISTINCT event_type, ',' ORDER BY event_type)"))
def ag21_sets(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return g.where(F.size("k") > 1).select("user_id", F.array_join(F.array_sort("k"), ",").alias("kinds"))


_BUDGET = "WITH s AS (SELECT *, sum(l_quantity) OVER w AS used, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)) "


@query(_BUDGET + "SELECT l_orderkey, l_linenumber, l_partkey, used FROM (SELECT *, max(CASE WHEN used > 60 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) AS over_ FROM s) WHERE over_ = 0")
def wn03_budget(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return context.budget(load(spark, d, "lineitem"), ["l_orderkey"], order, "l_quantity", 60).select("l_orderkey", "l_linenumber", "l_partkey", "used")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS pos FROM part")
def wn04_natural_order(spark, d):
    path = F.concat(F.lit("ст."), "p_size", F.lit("/п."), "p_partkey")
    return paths.positions(load(spark, d, "part").select("p_partkey", tx.natural_key(path).alias("key")), "key").select("p_partkey", "pos")


@query("SELECT o_custkey, o_orderkey, turn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders) ORDER BY turn, o_custkey LIMIT 500")
def wn05_round_robin(spark, d):
    return retrieval.round_robin(_orders(spark, d), "o_custkey", ["day", "o_orderkey"], 500).select("o_custkey", "o_orderkey", "turn")


@query("""WITH r AS (SELECT doc_id, sha256(text) AS path, row_number() OVER (PARTITION BY sha256(text) ORDER BY coalesce(text, '') = '', doc_id) AS rn FROM documents) SELECT doc_id, CASE WHEN rn = 1 THEN path ELSE path || '~' || rn END AS path FROM r""")
def wn07_dedupe_suffix(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("path"))
    return changes.dedupe_paths(docs, [], "path", "text", ["doc_id"]).select("doc_id", "path")


_CHANGED = """WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS signal FROM events), p AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM l) """


@query(_CHANGED + "SELECT event_id, signal, previous, signal IS NOT NULL AND previous IS NOT NULL AND signal <> previous AS changed FROM p")
def wn09_changed(spark, d):
    log = load(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("signal"))
    return changes.with_changes(log, "user_id", ["ts", "event_id"], "signal").select("event_id", "signal", "previous", "changed")


@query(_CHANGED + "SELECT CASE WHEN signal IS NULL THEN 'probe-fail' WHEN previous IS NOT NULL AND signal <> previous THEN 'changed' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY 1")
def co22_status(spark, d):
    log = load(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("signal"))
    seen = changes.with_changes(log, "user_id", ["ts", "event_id"], "signal")
    return seen.groupBy(changes.status(F.col("signal"), F.lit(""), F.col("changed")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def wn11_pairs(spark, d):
    return _orders(spark, d).select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")).alias("before"))


@query("SELECT doc_id, md5('1|' || doc_id) AS k FROM documents ORDER BY k, doc_id LIMIT 50")
def tk07_seeded_sample(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("1|"), F.col("doc_id").cast("string"))).alias("k")).orderBy("k", "doc_id").limit(50)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def st02_set_algebra(spark, d):
    o = _orders(spark, d)
    keys = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return keys("F").intersect(keys("O")).subtract(keys("P"))


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, user_id, event_id, used, used + amount <= 1500 AS allowed FROM (SELECT *, CAST(coalesce(sum(amount) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM (SELECT *, CAST(floor(value) AS BIGINT) AS amount FROM events))")
def sr04_daily_budget(spark, d):
    e = load(spark, d, "events").withColumn("amount", F.floor("value").cast("bigint"))
    return changes.daily_budget(e, "user_id", F.to_date("ts"), ["ts", "event_id"], "amount", 1500).select(F.col("day").cast("string").alias("day"), "user_id", "event_id", "used", "allowed")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 'NEW', 5.0")
def sk01_upsert(spark, d):
    old = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return changes.upsert(old, new.union(spark.createDataFrame([(-1, "NEW", 5.0)], "c_custkey long, c_mktsegment string, c_acctbal double")), ["c_custkey"], ["c_mktsegment"])


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'X'")
def sk02_insert_if_absent(spark, d):
    old = load(spark, d, "region").select("r_regionkey", "r_name")
    new = spark.createDataFrame([(1, "other"), (77, "X"), (77, "X")], "r_regionkey int, r_name string")
    return changes.insert_if_absent(old, new, ["r_regionkey"])


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, n_name) AS host FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def sk06_backfill(spark, d):
    s = load(spark, d, "supplier").withColumn("host", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))
    return s.join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("host", "n_name").alias("host"))
