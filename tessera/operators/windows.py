"""Frames that Spark's windows lack: GROUPS, EXCLUDE, FILTER with OVER, chained named windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED_BEFORE, UNBOUNDED_AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over frames of peer groups: groups are numbered by dense_rank, and a RANGE frame runs over the numbers."""
    numbered = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("_group").rangeBetween(start, end)
    return numbered.withColumns({k: v.over(w) for k, v in aggregates.items()}).drop("_group")


def exclude_sum_count(df: DataFrame, partition: list[str], order: list[Column], frame: Callable[[WindowSpec], WindowSpec], value: str, exclude: str, prefix: str) -> DataFrame:
    """prefix_sum and prefix_count of value over a frame without the current row, its group or its ties.

    Computed as the frame's aggregate less that of the excluded rows, so memory doesn't grow with the frame.
    The current group must lie in the frame for `group` and `ties` (frames by RANGE or GROUPS, or whole
    partitions); `current row` needs the current row in the frame.
    """
    w = frame(Window.partitionBy(*partition).orderBy(*order))
    peers = Window.partitionBy(*partition, "_group")
    out = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    own = F.coalesce(F.col(value), F.lit(0))
    has = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    less = {"no others": (F.lit(0), F.lit(0)), "current row": (own, has), "group": (F.sum(own).over(peers), F.sum(has).over(peers)), "ties": (F.sum(own).over(peers) - own, F.sum(has).over(peers) - has)}[exclude]
    n = F.count(value).over(w) - less[1]
    total = F.coalesce(F.sum(value).over(w), F.lit(0)) - less[0]
    return out.withColumn(f"{prefix}_count", n).withColumn(f"{prefix}_sum", F.when(n > 0, total)).drop("_group")


def exclude_any(df: DataFrame, partition: list[str], order: list[Column], unique: str, frame: Callable[[WindowSpec], WindowSpec], value: str, exclude: str, reduce: Callable[[Column], Column], name: str) -> DataFrame:
    """Any aggregate of an array over a frame with an exclusion; for aggregates that can't be subtracted. `unique` numbers the rows."""
    base = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_group", F.dense_rank().over(base))
    rows = F.collect_list(F.struct(F.col(unique).alias("id"), F.col("_group").alias("g"), F.col(value).alias("v"))).over(frame(base))
    keep = {"no others": lambda e: F.lit(True), "current row": lambda e: e["id"] != F.col(unique), "group": lambda e: e["g"] != F.col("_group"), "ties": lambda e: (e["g"] != F.col("_group")) | (e["id"] == F.col(unique))}[exclude]
    return out.withColumn("_rows", rows).withColumn(name, reduce(F.transform(F.filter("_rows", keep), lambda e: e["v"]))).drop("_rows", "_group")


def filtered(aggregate: Callable[[Column], Column], value: Column, condition: Column, window: WindowSpec) -> Column:
    """aggregate(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)


def chain(base: WindowSpec, order: list[Column]) -> WindowSpec:
    """A window that refines a named one by an order."""
    return base.orderBy(*order)
