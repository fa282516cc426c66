"""Aggregations: run summaries, confusion counts, percentile families, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.ranked import counted_values, null_safe_left, percentiles, value_at


def safe_mean(value: Column, digits: int = 3) -> Column:
    """The rounded mean; 0.0 of nothing."""
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits)


def run_summary(rows: DataFrame, group: list[str], failed: Column, measures: list[str]) -> DataFrame:
    """Counts of all, failed and good rows, and the mean of each measure."""
    means = [safe_mean(F.col(m)).alias(f"mean_{m}") for m in measures]
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.count_if(~failed).alias("n_ok"), *means)


def zero_filled(rows: DataFrame, column: str, domain: list) -> DataFrame:
    """(value, n) for every value of a fixed domain, those not found at 0."""
    known = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias("value"))
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(rows: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """A row for each gold label with a column for each predicted one and for missing or other predictions."""
    seen = rows.groupBy(F.col(gold).alias("gold")).agg(
        F.count("*").alias("support"),
        *(F.count_if(F.col(predicted) == p).alias(f"pred_{p}") for p in labels),
        F.count_if(~F.coalesce(F.col(predicted).isin(labels), F.lit(False))).alias("pred_missing"),
    )
    known = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("gold"))
    return F.broadcast(known).join(seen, "gold", "left").na.fill(0)


def macro_metrics(rows: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """One row of balanced accuracy, macro precision and macro F1 over a fixed support.

    A missing prediction is a false negative of its class and no false positive of another; precision without
    predictions is 0. Recalls of classes without support are left out of the mean.
    """
    sums = []
    for i, c in enumerate(labels):
        sums += [
            F.count_if((F.col(gold) == c) & (F.col(predicted) == c)).alias(f"tp{i}"),
            F.count_if((F.col(gold) != c) & (F.col(predicted) == c)).alias(f"fp{i}"),
            F.count_if(F.col(gold) == c).alias(f"n{i}"),
        ]
    one = rows.where(F.col(gold).isin(labels)).agg(*sums)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = range(len(labels))
    recall = F.array_compact(F.array(*(F.try_divide(F.col(f"tp{i}"), F.col(f"n{i}")) for i in each)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    precision = F.array(*(ratio(F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}")) for i in each))
    f1 = F.array(*(ratio(2 * F.col(f"tp{i}"), F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"n{i}")) for i in each))
    mean = lambda a: F.round(F.try_divide(total(a), F.size(a)), 6)
    return one.select(mean(recall).alias("balanced_accuracy"), mean(precision).alias("macro_precision"), mean(f1).alias("macro_f1"))


def describe(rows: DataFrame, value: str, group: list[str] = []) -> DataFrame:
    """n, mean, p50, p90, p95 (linear interpolation), max and sum, to three digits; n alone where there is nothing."""
    v = F.col(value).cast("double")
    out = rows.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.sum(v).alias("sum"))
    out = null_safe_left(out, percentiles(rows, group, v, {"p50": 0.5, "p90": 0.9, "p95": 0.95}), group)
    return out.select(*group, "n", *(F.round(c, 3).alias(c) for c in ("mean", "p50", "p90", "p95", "max", "sum")))


def nearest_rank(rows: DataFrame, value: str, group: list[str], points: list[float]) -> DataFrame:
    """Percentiles that are values of the data, at rank ceil(p * n)."""
    found = [value_at(F.greatest(F.ceil(F.col("n") * F.lit(p)) - 1, F.lit(0))).alias(f"p{round(p * 100)}") for p in points]
    ranks = counted_values(rows, group, F.col(value)).groupBy(*group).agg(*found)
    out = rows.groupBy(*group).agg(F.count(value).alias("n"), F.max(value).alias("max"))
    return null_safe_left(out, ranks, group).select(*group, "n", *(f"p{round(p * 100)}" for p in points), "max")


def cumulative_bins(rows: DataFrame, value: str, bounds: list[int], group: list[str] = []) -> DataFrame:
    """Counts of values at most each bound, and of those above the last; bins overlap."""
    bins = [F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds]
    return rows.groupBy(*group).agg(*bins, F.count_if(F.col(value) > bounds[-1]).alias(f"gt_{bounds[-1]}"))


def quartile_bounds(rows: DataFrame, value: str) -> DataFrame:
    """(q1, q2, q3): the values at index n * q // 4 of the sorted rows."""
    at = [value_at(F.floor(F.col("n") * q / 4)).alias(f"q{q}") for q in (1, 2, 3)]
    return counted_values(rows, [], F.col(value)).agg(*at)


def explode_counts(rows: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """How many rows hold each value of a list column; a row counts once for a value."""
    return rows.select(F.explode(F.array_distinct(values)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def map_means(rows: DataFrame, metrics: Column) -> DataFrame:
    """(metric, n, mean) of every numeric entry of a map column."""
    return rows.select(F.explode(metrics).alias("metric", "v")).groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def group_stats(rows: DataFrame, group: str, value: str, valid: Column, least: int = 2) -> DataFrame:
    """Size, valid members, mean, population deviation, whether a group trains, and why not."""
    v = F.when(valid, F.col(value).cast("double"))
    out = rows.groupBy(group).agg(F.count("*").alias("size"), F.count(v).alias("valid"), F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    flat = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    reason = F.when(F.col("valid") < least, "insufficient_valid_members").when(flat, "zero_reward_variance")
    return out.select(group, "size", "valid", F.round("mean", 6).alias("mean"), F.round(F.when(flat, 0.0).otherwise(F.col("std")), 6).alias("std"), reason.isNull().alias("trainable"), reason.alias("skip_reason"))


def reward(correct: Column, quality: Column, accepted: Column, floor: float) -> Column:
    """Outcome first: null where not accepted or unknown, 0 where wrong, else floor + (1 - floor) * clipped quality."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))
    return F.when(~accepted | correct.isNull(), None).when(~correct, 0.0).otherwise(F.round(floor + (1.0 - floor) * clipped, 8))
