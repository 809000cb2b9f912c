"""Validity intervals, the scope gate, latest-per-key and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def today(zone: str = "Europe/Kyiv") -> Column:
    """The calendar day in a zone, under a UTC session."""
    return F.to_date(F.from_utc_timestamp(F.current_timestamp(), zone))


def scope(df: DataFrame, as_of: str | None = None, start: str = "in_force_from", end: str = "in_force_to") -> DataFrame:
    """Rows in force on a day; both ends count and an open end is null. Apply it before anything is scored."""
    day = F.lit(as_of).cast("date") if as_of else today()
    return df.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))


def intervals(df: DataFrame, key: str, day: str, *ties: str) -> DataFrame:
    """Each row's validity: from its day to the day before the key's next one."""
    w = Window.partitionBy(key).orderBy(day, *ties)
    return df.withColumn("in_force_from", F.to_date(day)).withColumn("in_force_to", F.date_sub(F.to_date(F.lead(day).over(w)), 1))


def latest_per_key(df: DataFrame, key: str, order: list[str], n: int = 1) -> DataFrame:
    """The n last rows of each key; a window group limit prunes before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def editions(df: DataFrame, key: str, day: str, tie: str, since: str | None = None, current: bool = False) -> DataFrame:
    """Each key's editions with their turn: only the newest, those since a day from the newest on, or all from the oldest on."""
    down = current or since is not None
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if down else F.asc(c) for c in (day, tie)])
    some = df.where(F.col(day) >= F.lit(since).cast("date")) if since else df
    turned = some.withColumn("turn", F.row_number().over(w))
    return turned.where("turn = 1") if current else turned


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the key's last right row at or before its time.

    Both sides are laid in one ordered sequence for each key and values carried forward, so there is one shuffle and no
    product of the sides.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(_struct_of(right, values)))
    b = right.select(key, F.lit(0).alias("_side"), F.col(right_time).alias("_t"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return filled.where("_side = 1").select(*left.columns, *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in values])


def _struct_of(df: DataFrame, columns: list[str]) -> str:
    return "struct<" + ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"
