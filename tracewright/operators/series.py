"""Ordered series: moving averages, spikes, regressions, streaks, first and last events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.operators.ranked import null_safe_left, percentiles


def _upto(key: list[str], order: list[str], first: int, last: int):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(first, last)


def moving_average(rows: DataFrame, key: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """The mean of the last ``window`` values, fewer at the start; NaN where one of them is not finite."""
    w = _upto(key, order, -(window - 1), 0)
    bad = F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf"))
    spoiled = F.max(bad.cast("int")).over(w) == 1
    return rows.withColumn("moving_average", F.when(spoiled, float("nan")).otherwise(F.avg(value).over(w)))


def segments(rows: DataFrame, key: list[str], step: str, value: str, size: int) -> DataFrame:
    """Disjoint segments (n - 1) * size < step <= n * size: rows, mean, first and last value, completeness."""
    number = F.ceil(F.col(step) / size).cast("long")
    out = rows.withColumn("segment", number).groupBy(*key, "segment")
    return out.agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min_by(value, step).alias("first_value"),
        F.max_by(value, step).alias("last_value"), (F.max(step) == F.max(F.col("segment") * size)).alias("complete"),
    )


def decumulate(rows: DataFrame, key: list[str], order: list[str], value: str, digits: int = 6) -> DataFrame:
    """What a running mean's single values were: mean_i * i - mean_(i-1) * (i-1), not below 0."""
    w = Window.partitionBy(*key).orderBy(*order)
    i = F.row_number().over(w)
    single = F.col(value) * i - F.coalesce(F.lag(value).over(w), F.lit(0.0)) * (i - 1)
    return rows.withColumn("single", F.round(F.greatest(F.lit(0.0), single), digits))


def spikes(rows: DataFrame, key: list[str], order: list[str], value: str, window: int, factor: float, floor: float = 0.0, least: int = 4) -> DataFrame:
    """Rows with the median of the ``window`` rows before them, and whether they exceed it by factor and floor."""
    before = _upto(key, order, -window, -1)
    seen = F.count(value).over(_upto(key, order, Window.unboundedPreceding, 0))
    median = F.percentile(F.col(value).cast("double"), F.lit(0.5)).over(before)
    out = rows.withColumn("prior_median", median).withColumn("seen", seen)
    v = F.col(value)
    is_spike = (F.col("seen") >= least) & (F.col("prior_median") > 0) & (v >= F.col("prior_median") * factor) & (v - F.col("prior_median") >= floor)
    return out.withColumn("is_spike", F.coalesce(is_spike, F.lit(False))).drop("seen")


def regressions(rows: DataFrame, key: list[str], order: list[str], value: str, fraction: float, floor: float) -> DataFrame:
    """Rows with the least value before them, and whether they are worse by fraction and floor."""
    best = F.min(value).over(_upto(key, order, Window.unboundedPreceding, -1))
    out = rows.withColumn("prior_best", best)
    v = F.col(value)
    worse = (F.col("prior_best") > 0) & (v >= F.col("prior_best") * (1 + fraction)) & (v - F.col("prior_best") >= floor)
    return out.withColumn("regressed", F.coalesce(worse, F.lit(False)))


def longest_streak(rows: DataFrame, key: list[str], order: list[str], holds: Column) -> DataFrame:
    """The most consecutive rows of each key for which a condition holds."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("_holds", F.coalesce(holds, F.lit(False))).withColumn("_all", F.row_number().over(w))
    inner = Window.partitionBy(*key, "_holds").orderBy(*order)
    islands = marked.withColumn("_island", F.col("_all") - F.row_number().over(inner))
    runs = islands.groupBy(*key, "_holds", "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(*key).agg(F.max(F.when(F.col("_holds"), F.col("n")).otherwise(0)).alias("longest_streak"))


def first_event(rows: DataFrame, key: list[str], order: Column, holds: Column, value: str) -> DataFrame:
    """The value of the first row of each key for which a condition holds; null where none does."""
    return rows.groupBy(*key).agg(F.min_by(F.when(holds, F.col(value)), F.when(holds, order)).alias(f"first_{value}"))


def after_last(rows: DataFrame, key: list[str], order: Column, holds: Column) -> DataFrame:
    """How many rows of each key come after the last for which a condition holds; 0 where none does."""
    last = F.max(F.when(holds, order)).over(Window.partitionBy(*key))
    marked = rows.withColumn("_after", F.coalesce(order > last, F.lit(False)))
    return marked.groupBy(*key).agg(F.count_if("_after").alias("n_after"))


def rate(rows: DataFrame, key: list[str], time: str, value: str, order: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The change of a counter per second since the row before, by time or by ``order``; null at the first and where no time passed.

    Times are subtracted as whole microseconds: as seconds since 1970 they would be a tenth of one off. Halves at the last of
    ``digits`` are told by the product with its power of ten, as DuckDB does.
    """
    w = Window.partitionBy(*key).orderBy(*(order or [time]))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    found = F.try_divide((F.col(value) - F.lag(value).over(w)).cast("double"), (micros - F.lag(micros).over(w)) / 1e6)
    out = rows.withColumn("rate", found)
    if digits is None:
        return out
    power, r = 10.0**digits, F.col("rate")
    return out.withColumn("rate", F.when(F.abs(r) < 1e300, F.round(r * power) / power).otherwise(r) + F.lit(0.0))


def step_profile(rows: DataFrame, group: list[str], value: str, stall: float = 1.5) -> DataFrame:
    """Mean, median, p90, max, variation and the number of values over ``stall`` medians."""
    v = F.col(value).cast("double")
    whole = rows.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    whole = null_safe_left(whole, percentiles(rows, group, v, {"median": 0.5, "p90": 0.9}), group)
    slow = rows.join(whole.select(*group, "median"), group).groupBy(*group).agg(F.count_if(v > stall * F.col("median")).alias("stalls"))
    out = whole.join(slow, group)
    return out.select(*group, "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "max")), F.round(F.try_divide(F.col("std"), F.col("mean")), 6).alias("variation"), "stalls")
