"""Differences between snapshots, upserts, and change detection over signal logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed and same keys; null-safe."""
    a = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, F.col("_old").alias("old"), F.col("_new").alias("new"), status.alias("status"))


def ledger_diff(ledger: DataFrame, live: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Known keys whose live value differs or is gone, and live keys that the ledger lacks."""
    return snapshot_diff(ledger, live, keys, value).where("status <> 'same'").withColumn("status", F.when(F.col("status") == "added", "new").otherwise("changed_or_deleted"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str]) -> DataFrame:
    """New rows replace old ones by key; columns of keep_if_null keep the old value where the new one is null."""
    a, b = old.alias("a"), new.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    fresh = F.col(f"b.{keys[0]}").isNotNull()
    cols = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in keys else F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in keep_if_null else F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns]
    return a.join(b, cond, "full_outer").select(*cols)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """What a cascading delete leaves: the children whose parent is still there."""
    return children.join(parents.select(*keys), keys, "left_semi")


def coherence(mirror: DataFrame, registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, problem): missing from the registry, orphan in it, or a field that differs."""
    missing = mirror.join(registry, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    orphan = registry.join(mirror, key, "left_anti").select(key, F.lit("orphan").alias("problem"))
    m, r = mirror.alias("m"), registry.alias("r")
    drift = F.filter(F.array(*[F.when(~F.col(f"m.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f"drift:{f}")) for f in fields]), lambda x: x.isNotNull())
    differ = m.join(r, F.col(f"m.{key}") == F.col(f"r.{key}")).select(F.col(f"m.{key}").alias(key), F.explode(drift).alias("problem"))
    return missing.union(orphan).union(differ)


def with_changes(log: DataFrame, source: str, order: list[str], signal: str) -> DataFrame:
    """previous: the source's last signal that was not null; changed: there is one and this signal differs from it."""
    before = F.last(signal, ignorenulls=True).over(Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("previous", before).withColumn("changed", F.col(signal).isNotNull() & F.col("previous").isNotNull() & (F.col(signal) != F.col("previous")))


def status(signal: Column, note: Column, changed: Column) -> Column:
    """Ordered rules of a probe's status."""
    note = F.coalesce(note, F.lit(""))
    return (
        F.when(signal.isNull() & ~F.contains(note, F.lit("manual")), "probe-fail").when(note.rlike(r"HTTP [45]\d\d"), "bad-url").when(F.contains(note, F.lit("off-pin")), "off-pin")
        .when(changed, "changed").when(F.contains(note, F.lit("manual")), "manual").otherwise("ok")
    )


def set_hash(values: Column) -> Column:
    """The first 16 hex digits of the sha256 of the sorted distinct values joined by bars."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(values)), "|"), 256), 1, 16)


def dense_cluster_max(df: DataFrame, group: str, value: str, gap: int) -> DataFrame:
    """For each group the largest value before the first gap wider than gap, over ascending distinct values."""
    w = Window.partitionBy(group).orderBy(value)
    flagged = df.select(group, value).distinct().withColumn("_gap", F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0))
    return flagged.withColumn("_gaps", F.sum("_gap").over(w)).where("_gaps = 0").groupBy(group).agg(F.max(value).alias("cluster_max"))


def dedupe_paths(df: DataFrame, keys: list[str], path: str, text: str, order: list[str]) -> DataFrame:
    """Rows with text come first; later rows of one path get ~2, ~3 and so on."""
    rn = F.row_number().over(Window.partitionBy(*keys, path).orderBy(F.coalesce(F.col(text), F.lit("")) == "", *order))
    return df.withColumn("_rn", rn).withColumn(path, F.when(F.col("_rn") == 1, F.col(path)).otherwise(F.concat(path, F.lit("~"), "_rn"))).drop("_rn")


def daily_budget(df: DataFrame, host: str, day: Column, order: list[str], size: str, cap: int) -> DataFrame:
    """used before each request of a host and day, and whether it is allowed under the cap."""
    w = Window.partitionBy(host, "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("day", day).withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("allowed", F.col("used") + F.col(size) <= cap)
