"""Exact order statistics of groups of any size: values are counted, then ranked in range partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.session import Scratch


def counted_values(rows: DataFrame, group: list[str], value: Column) -> DataFrame:
    """(group, v, upto, n): each distinct value that is not null, the values up to it and the values of its group.

    Equal values are counted before the shuffle. The counts are written once, in range partitions with their numbers; a
    group that spans partitions takes the sums of those before from a table of a row for each partition and group.
    The write is a job of its own.
    """
    counts = rows.select(*group, value.alias("v")).where("v is not null").groupBy(*group, "v").agg(F.count("*").alias("k"))
    spread = counts.repartitionByRange(*(F.col(c) for c in [*group, "v"])).withColumn("_part", F.spark_partition_id())
    spread = Scratch(rows.sparkSession, "ranked").save(spread, "values")
    local = spread.withColumn("_local", F.sum("k").over(Window.partitionBy("_part", *group).orderBy("v")))
    sums = spread.groupBy("_part", *group).agg(F.sum("k").alias("_k"), F.min("v").alias("_low"))
    whole = Window.partitionBy(*group)
    before = F.sum("_k").over(whole.orderBy("_low")) - F.col("_k")
    sums = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(group)), before.alias("_before"), F.sum("_k").over(whole).alias("n"))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(group)), F.col("_part") == F.col("_p"))
    return local.join(sums, on).select(*group, "v", (F.col("_local") + F.col("_before")).alias("upto"), "n")


def value_at(index: Column) -> Column:
    """The value at an index, from 0, of the sorted values of a group of ``counted_values``."""
    return F.min(F.when(F.col("upto") > index, F.col("v")))


def interpolated(points: list[float]) -> list[tuple[Column, Column]]:
    """For each point the values on either side of it, to go into one aggregate of ``counted_values``."""
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    return [(value_at(F.floor(place(p))), value_at(F.ceil(place(p)))) for p in points]


def between(low: Column, high: Column, n: Column, p: float) -> Column:
    """Linear interpolation between the values on either side of a point."""
    share = (n - 1) * F.lit(p) - F.floor((n - 1) * F.lit(p))
    return low * (1 - share) + high * share


def percentiles(rows: DataFrame, group: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """(group, and a column for each named point) of exact, linearly interpolated percentiles; no row for a group of nulls."""
    ends = [c.alias(f"_{name}{side}") for name, pair in zip(points, interpolated(list(points.values()))) for side, c in enumerate(pair)]
    found = counted_values(rows, group, value.cast("double")).groupBy(*group).agg(F.max("n").alias("_n"), *ends)
    return found.select(*group, *(between(F.col(f"_{name}0"), F.col(f"_{name}1"), F.col("_n"), p).alias(name) for name, p in points.items()))


def null_safe_left(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, whose groups are unique; null groups meet."""
    held = right.select(*(F.col(c).alias(f"_{c}") for c in group), *(c for c in right.columns if c not in group))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group), F.lit(True))
    return left.join(held, on, "left").drop(*(f"_{c}" for c in group))
