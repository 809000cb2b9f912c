"""Source, sink and streaming queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import signals
from tidemark.session import load, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name):
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@query()
def sc11_page_pairs(spark, d):
    return files.page_pairs(load(spark, d, "pages"), "page_id", "html", "p")


@query("SELECT row_number() OVER (ORDER BY item_id) AS line, item_id, length(text) AS n FROM benchmark")
def sc06_jsonl_lines(spark, d):
    path = _folder(spark, "jsonl")
    b = load(spark, d, "benchmark").select("item_id", "text")
    b.repartition(1).sortWithinPartitions("item_id").write.json(path)
    return files.read_jsonl(spark, path, "item_id long, text string").select("line", "item_id", F.length("text").alias("n"))


@query("SELECT s_nationkey, s_suppkey, CASE WHEN s_nationkey < 5 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier")
def sk03_replace_partition(spark, d):
    path = _folder(spark, "parts")
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    files.replace_partitions(s, path, ["s_nationkey"])
    files.replace_partitions(s.where("s_nationkey < 5").withColumn("s_name", F.upper("s_name")), path, ["s_nationkey"])
    return spark.read.parquet(path).select("s_nationkey", "s_suppkey", "s_name")


@query("""WITH l AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS signal FROM events), p AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM l)
SELECT user_id AS source, event_id AS id, signal, previous, signal IS NOT NULL AND previous IS NOT NULL AND signal <> previous AS changed FROM p""")
def st_stream_changed(spark, d):
    """The stream of all events, taken as it is landed, once."""
    source, out, check = _folder(spark, "stream-in"), _folder(spark, "stream-out"), _folder(spark, "stream-check")
    log = load(spark, d, "events").select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("signal"))
    log.write.parquet(source)
    stream = signals.stream_changes(spark.readStream.schema(log.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query()
def co15_parse(spark, d):
    """Documents read as editions of their source: preambles, points and what else their lines show."""
    from tidemark.operators.corpus import parse_editions

    return parse_editions(load(spark, d, "documents").select(F.col("source").alias("act"), F.col("doc_id").alias("edition"), "text"))


@query()
def co17_chunks(spark, d):
    from tidemark.operators.corpus import build_chunks

    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    units = co15_parse(spark, d).withColumn("edition", day(F.col("edition"))).withColumn("n_tokens", F.ceil(F.length("text") / 4))
    # as of the last day of the data, as a string: Python has no dates beyond the year 9999
    last = load(spark, d, "documents").agg(day(F.max("doc_id")).cast("string")).first()[0]
    return build_chunks(units, last).select("act", F.col("edition").cast("string").alias("edition"), "unit_path", "route", "citation", "content_hash")
