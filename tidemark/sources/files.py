"""Text, JSON-lines and page sources; partition, record and report sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, UTF-8 where valid, else Windows-1251."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Windows-1251: its upper half by way of Latin-1, whose characters are the bytes."""
    upper = bytes(range(0x80, 0x100))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode("cp1251", "replace")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records with the line each stands on (1-based, blank lines counted); a line that is no record raises an error.

    For reference sets and run records: each file is split in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "raw")).where(F.trim("raw") != "")
    parsed = lines.withColumn("r", F.from_json("raw", schema))
    checked = parsed.withColumn("r", F.when(F.try_parse_json("raw").isNull(), F.raise_error(F.concat(F.lit("line "), F.col("i") + 1, F.lit(" is no record"))).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")))
    return checked.select((F.col("i") + 1).alias("line"), "r.*")


def read_run(spark: SparkSession, path: str, schema: str, kind: str) -> tuple[dict, DataFrame]:
    """A run file's header (the record of that kind) and its detail rows."""
    rows = read_jsonl(spark, path, schema)
    header = rows.where(F.col("kind") == kind).first()
    return (header.asDict() if header else {}), rows.where(F.coalesce(F.col("kind"), F.lit("")) != kind)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace exactly the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_jsonl(df: DataFrame, path: str, header: str | None = None) -> None:
    """Records as JSON lines, after a header record if there is one; one file, for reports."""
    rows = df.select(F.to_json(F.struct("*")).alias("value"), F.lit(1).alias("part"))
    if header:
        rows = rows.unionByName(df.sparkSession.createDataFrame([(header, 0)], "value string, part int"))
    rows.repartition(1).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def publishable(text: Column) -> Column:
    """No replacement character: a text that lost characters on the way is not stored."""
    return ~F.contains(text, F.lit("�"))


def run_summary(stdout: Column) -> dict[str, Column]:
    """ok, failed and bytes of the last summary line of a run's output."""
    rx = r"(?m)^SUMMARY ok=(\d+) failed=(\d+) bytes=(\d+)"
    return {n: F.element_at(F.regexp_extract_all(stdout, F.lit(rx), i), -1).cast("long") for i, n in enumerate(("ok", "failed", "bytes"), 1)}


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A report's rows as a Markdown table; for a few rows."""
    cols = df.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cols]), F.lit(" |"))
    rows = [r[0] for r in df.orderBy(*order).select(line).collect()]
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *rows])


def answer_html(answers: DataFrame) -> DataFrame:
    """(id, html) of answers (id, question, conclusion, actions array, citations array): escaped, internal ids removed."""
    safe = lambda c: tx.html_escape(tx.prose(c))
    items = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), safe(x), F.lit("</li>"))), "")
    return answers.select("id", F.concat(F.lit("<h1>"), safe(F.col("question")), F.lit("</h1><p>"), safe(F.col("conclusion")), F.lit("</p><ol>"), items(F.col("actions")), F.lit("</ol><ul>"), items(F.col("citations")), F.lit("</ul>")).alias("html"))


class _Pairs(HTMLParser):
    """Headings and the text up to the next heading, as question and answer."""

    def __init__(self, heading: str) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.out, self.depth, self.skip = heading, [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == self.heading:
            self.out.append(["", ""])
            self.depth = 1
        elif self.depth and tag not in VOID:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.depth and tag not in VOID:
            self.depth -= 1

    def handle_data(self, data):
        if self.out and not self.skip:
            self.out[-1][0 if self.depth else 1] += data


def page_pairs(pages: DataFrame, id_col: str, html_col: str, heading: str = "h2") -> DataFrame:
    """(id, pos, question, answer): each heading of a page with the text under it; void tags do not nest."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, html in zip(pdf["id"], pdf["html"], strict=True):
                p = _Pairs(heading)
                p.feed(html or "")
                rows.extend((key, i, " ".join(q.split()), " ".join(a.split())) for i, (q, a) in enumerate(p.out, 1))
            yield pd.DataFrame(rows, columns=["id", "pos", "question", "answer"])

    base = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return base.mapInPandas(work, f"id {base.schema['id'].dataType.simpleString()}, pos int, question string, answer string")
