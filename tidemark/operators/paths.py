"""Materialised paths: prefix predicates, leaves, containers and natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import landed


def under(path: Column, root: Column | str) -> Column:
    """path is root or below it; a longer name that starts alike is not."""
    root = F.lit(root) if isinstance(root, str) else root
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def _ancestors(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Every strict ancestor of every path: an equi-join key, so no prefix comparison is needed."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return df.where(F.contains(path, F.lit("/"))).select(*keys, F.explode(up).alias(path)).distinct()


def leaves(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows without a strict descendant under the same keys."""
    return df.join(_ancestors(df, keys, path), [*keys, path], "left_anti")


def containers(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """All rows, with has_kids."""
    return df.join(_ancestors(df, keys, path).withColumn("_k", F.lit(True)), [*keys, path], "left").withColumn("has_kids", F.coalesce("_k", F.lit(False))).drop("_k")


def positions(df: DataFrame, key: str) -> DataFrame:
    """df with pos, each row's number in the order of key over the whole table.

    Ranges of keys are sorted and numbered apart, then moved by the rows of the ranges before; only the ranges' sizes reach
    the driver.
    """
    at = F.col("_at")
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    # the id holds the range above 33 bits of place within it
    held = landed(ranged.select(*df.columns, F.shiftright(at, 33).alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "positions")
    starts, before = [], 0
    for r in sorted(held.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):
        starts.append((r["_range"], before))
        before += r["n"]
    moved = held.join(F.broadcast(df.sparkSession.createDataFrame(starts, "_range long, _before long")), "_range")
    return moved.select(*df.columns, (F.col("_before") + at + 1).alias("pos"))
