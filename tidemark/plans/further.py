"""Edition selectors, lookups, cascades, verdicts, nested values, probes and sinks, with equal SQL over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import changes, quality, temporal
from tidemark.session import load, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT 'current' AS mode, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS turn FROM orders QUALIFY turn = 1
UNION ALL SELECT 'since', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) FROM orders WHERE o_orderdate >= DATE '1999-01-01'
UNION ALL SELECT 'history', o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders""")
def sc03_editions(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    modes = {"current": {"current": True}, "since": {"since": "1999-01-01"}, "history": {}}
    parts = [temporal.editions(o, "o_custkey", "o_orderdate", "o_orderkey", **how).select(F.lit(m).alias("mode"), "o_custkey", "o_orderkey", "turn") for m, how in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"SELECT s_suppkey, 'S-' || (CAST(regexp_extract(s_name, '(\d+)', 1) AS BIGINT) + 2000) AS label FROM supplier WHERE regexp_matches(s_name, '\d')")
def sc10_labels(spark, d):
    n = F.regexp_extract("s_name", r"(\d+)", 1)
    return load(spark, d, "supplier").where(n != "").select("s_suppkey", F.concat(F.lit("S-"), n.cast("bigint") + 2000).alias("label"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN substr(sha256(html), 1, 16) WHEN 1 THEN CAST(length(html) AS VARCHAR) END AS signal, CASE page_id % 3 WHEN 0 THEN 'page-hash' WHEN 1 THEN 'length' ELSE 'manual' END AS note FROM pages""")
def sc12_probe(spark, d):
    kind = F.pmod("page_id", F.lit(3))
    signal = F.when(kind == 0, tx.short_hash(F.col("html"))).when(kind == 1, F.length("html").cast("string"))
    return load(spark, d, "pages").select("page_id", signal.alias("signal"), F.when(kind == 0, "page-hash").when(kind == 1, "length").otherwise("manual").alias("note"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= current_date")
def pf02_server_date(spark, d):
    return load(spark, d, "orders").where(F.to_date("o_orderdate") <= F.current_date()).select("o_orderkey")


@query("""WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents), k AS (SELECT DISTINCT h, 'v' || (doc_id % 2) AS version FROM c) SELECT doc_id, version FROM c JOIN k USING (h) WHERE version = 'v1'""")
def jn02_version_pin(spark, d):
    c = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = c.select("h", F.concat(F.lit("v"), F.pmod("doc_id", F.lit(2))).alias("version")).where("version = 'v1'").distinct()
    return c.join(cache, "h").select("doc_id", "version")


@query("""SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def jn10_lookups(spark, d):
    few = load(spark, d, "nation").where("n_nationkey % 5 <> 0")
    j = load(spark, d, "supplier").join(few, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("""SELECT source, count(*) AS candidates, count(l.doc_id) AS kept, count(*) - count(l.doc_id) AS dropped, coalesce(min(CASE WHEN l.doc_id IS NULL THEN d.doc_id END), -1) AS first_dropped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def jn11_enrichment(spark, d):
    hits = load(spark, d, "documents").select("doc_id", "source")
    j = hits.join(load(spark, d, "labels").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    miss = F.count("*") - F.count("hit")
    return j.groupBy("source").agg(F.count("*").alias("candidates"), F.count("hit").alias("kept"), miss.alias("dropped"), F.coalesce(F.min(F.when(F.col("hit").isNull(), F.col("doc_id"))), F.lit(-1)).alias("first_dropped"))


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)""")
def jn20_cascade(spark, d):
    kept = load(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.cascade(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), kept, ["l_orderkey"])


@query("SELECT lang AS kind, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def ag13_failing(spark, d):
    """A row an id, since a kind's ids have no bound."""
    return load(spark, d, "documents").select("doc_id", F.col("lang").alias("kind")).join(load(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").select("kind", "doc_id")


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS texts, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_share FROM documents GROUP BY 1")
def ag22_duplicates(spark, d):
    g = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))
    return g.withColumn("duplicate_share", F.round((F.col("n") - F.col("texts")) / F.col("n"), 6))


@query("""SELECT user_id, count(*) AS attempted, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) > 0 AND count(*) FILTER (WHERE event_type = 'error') / count(*) <= 0.25 AS passed FROM events GROUP BY 1""")
def ag24_error_rate(spark, d):
    return quality.error_rate(load(spark, d, "events"), "user_id", F.col("event_type") == "error", 0.25)


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS spot FROM documents), f AS (SELECT doc_id, word, min(spot) AS spot FROM w GROUP BY 1, 2)
SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS pos FROM f""")
def st07_ordered_dedup(spark, d):
    """Each text's words without repeats, in the order of their first places."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.array_distinct(F.split("text", " "))).alias("at", "word")).select("doc_id", "word", (F.col("at") + 1).cast("long").alias("pos"))


@query("""WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'див. ст. ' || p_size WHEN 1 THEN 'міст. ' || p_size WHEN 2 THEN 'Стаття ' || p_size ELSE p_name END AS t FROM part)
SELECT p_partkey, regexp_matches(lower(t), '(^|[^\\p{L}])(ст\\.?|статт\\p{L}*)\\s*\\d') AS has_article FROM q""")
def fn06_has_article(spark, d):
    kind = F.pmod("p_partkey", F.lit(4))
    t = F.when(kind == 0, F.concat(F.lit("див. ст. "), "p_size")).when(kind == 1, F.concat(F.lit("міст. "), "p_size")).when(kind == 2, F.concat(F.lit("Стаття "), "p_size")).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", t.rlike(r"(?iu)(?<!\p{L})(ст\.?|статт\p{L}*)\s*\d").alias("has_article"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS rel FROM pages")
def fn24_relative(spark, d):
    return load(spark, d, "pages").select("page_id", tx.relative(F.col("url"), "https://").alias("rel"))


@query("""WITH q AS (SELECT p.p_partkey, l_orderkey, l_linenumber, abs(l_extendedprice / l_quantity - p_retailprice) AS delta FROM lineitem JOIN part p ON l_partkey = p_partkey) SELECT p_partkey, count(*) AS checked, count(*) FILTER (WHERE delta > 500) AS drifted FROM q GROUP BY 1""")
def ma04_drift(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    delta = F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice"))
    return j.groupBy("p_partkey").agg(F.count("*").alias("checked"), F.count_if(delta > 500).alias("drifted"))


@query("SELECT doc_id, len(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' ')))) AS pieces, md5(array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' '))), '|')) AS h FROM documents")
def ar02_flatten(spark, d):
    flat = F.flatten(F.transform(F.split("text", "\n"), lambda x: F.split(x, " ")))
    return load(spark, d, "documents").select("doc_id", F.size(flat).cast("long").alias("pieces"), F.md5(F.array_join(flat, "|")).alias("h"))


@query("SELECT DISTINCT event_id, CAST(json_extract_string(x, '$.k') AS BIGINT) AS k FROM (SELECT event_id, unnest(['{\"k\":1}', props]) AS x FROM events)")
def js02_array_of_objects(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat(F.lit('[{"k":1},'), "props", F.lit("]")).alias("j"))
    return e.select("event_id", F.explode(F.from_json("j", "array<struct<k: bigint>>")).alias("x")).select("event_id", "x.k").distinct()


@query("SELECT event_id, NOT json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END) AS truncated FROM events")
def js03_truncated(spark, d):
    j = F.when(F.pmod("event_id", F.lit(3)) == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return load(spark, d, "events").select("event_id", F.try_parse_json(j).isNull().alias("truncated"))


@query("SELECT c_custkey, CASE WHEN o.o_custkey IS NOT NULL THEN 'orders/' || o.last ELSE c_name END AS path FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.o_custkey = c_custkey")
def sk04_point_update(spark, d):
    news = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("orders/"), F.max("o_orderkey")).alias("new"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(news, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_name").alias("path"))


@query("SELECT n_nationkey, n_name, count(*) AS rows_kept FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2")
def sk07_append(spark, d):
    path = f"{shared_dir(spark)}/tidemark/append-{uuid.uuid4().hex}"
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.mode("append").parquet(path)
    n.where("n_regionkey = 1").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("rows_kept"))


@query("""SELECT '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS manifest FROM (SELECT o_orderstatus || '|' || o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1)""")
def sk09_manifest(spark, d):
    """One JSON object with sorted keys; a manifest's keys are few by its nature."""
    g = load(spark, d, "orders").groupBy(F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("manifest"))


@query("""WITH g AS (SELECT p_partkey, p_brand AS act, CASE WHEN p_partkey % 4 = 0 THEN 'розд.' || p_size WHEN p_partkey % 4 = 1 THEN 'ст.' || p_size || '-1' ELSE 'ст.' || p_size END AS article FROM part), a AS (SELECT DISTINCT p_brand AS act FROM part WHERE p_size > 45)
SELECT p_partkey, CASE WHEN act NOT IN (SELECT act FROM a) THEN 'unknown act' WHEN NOT regexp_matches(article, '^ст\\.\\d+(-\\d+)?$') THEN 'article shape' ELSE 'ok' END AS verdict FROM g""")
def co28_gold_validator(spark, d):
    p = load(spark, d, "part")
    kind = F.pmod("p_partkey", F.lit(4))
    article = F.when(kind == 0, F.concat(F.lit("розд."), "p_size")).when(kind == 1, F.concat(F.lit("ст."), "p_size", F.lit("-1"))).otherwise(F.concat(F.lit("ст."), "p_size"))
    return quality.validate_gold(p.select("p_partkey", F.col("p_brand").alias("act"), article.alias("article")), p.where("p_size > 45").select(F.col("p_brand").alias("act")).distinct()).select("p_partkey", "verdict")


@query("""WITH l AS (SELECT DISTINCT p_partkey AS a, trim(unnest(string_split(p_name, ' '))) AS b FROM part), k AS (SELECT DISTINCT p_name AS b FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part WHERE p_size < 10)
SELECT a, count(*) AS links, count(k.b) AS resolved FROM l LEFT JOIN k USING (b) WHERE l.b <> '' GROUP BY 1""")
def co20_links(spark, d):
    p = load(spark, d, "part")
    links = p.select(F.col("p_partkey").alias("a"), F.explode(F.split("p_name", " ")).alias("b")).withColumn("b", F.trim("b")).where("b <> ''").distinct()
    known = p.select(F.col("p_name").alias("b")).union(p.where("p_size < 10").select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct().withColumn("k", F.lit(True))
    return links.join(known, "b", "left").groupBy("a").agg(F.count("*").alias("links"), F.count("k").alias("resolved"))


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY 1, 2")
def ag23_day_sums(spark, d):
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.floor("value").cast("bigint")).alias("bytes"))
