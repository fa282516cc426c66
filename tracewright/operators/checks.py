"""Fail-closed expectations, and joins that check their references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.session import Scratch


class ExpectationError(ValueError):
    """An input breaks a rule that the result relies on."""


def _sample(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(str(tuple(r)) for r in df.select(*keys).limit(5).collect())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., copies) of keys that are blank or found more than once."""
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where((F.col("copies") > 1) | blank)


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``df``, or an error that names blank or repeated keys."""
    if found := _sample(duplicate_keys(df, keys), keys):
        raise ExpectationError(f"{name}: blank or repeated keys: {found}")
    return df


def require_references(rows: DataFrame, known: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``rows``, or an error where a key is not among ``known``."""
    if found := _sample(rows.join(known.select(*keys), keys, "left_anti"), keys):
        raise ExpectationError(f"{name}: unknown keys: {found}")
    return rows


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    require_references(a, b, keys, "left")
    require_references(b, a, keys, "right")


def require_count(df: DataFrame, expected: int, name: str = "table") -> DataFrame:
    if (n := df.count()) != expected:
        raise ExpectationError(f"{name}: {n} rows, not {expected}")
    return df


def checked_join(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows to a table that has each key once and every key that rows use."""
    require_unique(known, keys, "reference table")
    return require_references(rows, known, keys, "rows").join(known, keys)


def first_failure(checks: dict[str, Column], passed: str = "ok") -> Column:
    """The name of the first check that fails, in order; a check that is null fails."""
    out = F.lit(passed)
    for name, holds in reversed(checks.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def all_failures(checks: dict[str, Column]) -> Column:
    """The names of all checks that fail, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in checks.items())))


def verified_join(rows: DataFrame, cache: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Full outer join on keys, routed: resolved, rejected with the first attribute that differs, missing, or orphan.

    (keys..., route, reason). A cache row whose target was rejected was not consumed: its own row says orphan.
    """
    left = rows.select(*keys, *(F.col(a).alias(f"want_{a}") for a in attributes), F.lit(True).alias("wanted"))
    right = cache.select(*keys, *(F.col(a).alias(f"have_{a}") for a in attributes), F.lit(True).alias("cached"))
    both = left.join(right, keys, "full_outer")
    reason = first_failure({f"{a}_mismatch": F.col(f"want_{a}").eqNullSafe(F.col(f"have_{a}")) for a in attributes}, "")
    both = both.withColumn("reason", F.when(F.col("wanted").isNull(), "not_wanted").when(F.col("cached").isNull(), "not_cached").otherwise(reason))
    route = F.when(F.col("wanted").isNull(), F.array(F.lit("orphan"))).when(F.col("cached").isNull(), F.array(F.lit("missing")))
    route = route.when(F.col("reason") == "", F.array(F.lit("resolved"))).otherwise(F.array(F.lit("rejected"), F.lit("orphan")))
    return both.select(*keys, F.explode(route).alias("route"), "reason")


def left_default(targets: DataFrame, found: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every target, with the found row or the default one."""
    present = found.withColumn("_present", F.lit(True))
    joined = targets.join(present, keys, "left")
    filled = [F.when(F.col("_present").isNull(), F.lit(defaults[c])).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in joined.columns if c != "_present"]
    return joined.select(*filled)


def alias_index(rows: DataFrame, canonical: str, aliases: list[Column]) -> tuple[DataFrame, DataFrame]:
    """((alias, canonical) of unambiguous aliases, (alias, owners) of the ambiguous ones)."""
    told = rows.select(F.col(canonical).alias("canonical"), F.explode(F.array(F.col(canonical).cast("string"), *aliases)).alias("alias"))
    owners = told.where("alias is not null and alias <> ''").groupBy("alias").agg(F.countDistinct("canonical").alias("owners"), F.min("canonical").alias("canonical"))
    return owners.where("owners = 1").select("alias", "canonical"), owners.where("owners > 1").select("alias", "owners")


def conflicting(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys under which more than one label is found: (key, n_labels)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def slot_coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state): filled, missing, unexpected, or repeated."""
    have = actual.groupBy(*keys).agg(F.count("*").alias("copies"))
    both = expected.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(have, keys, "full_outer")
    state = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "repeated").otherwise("filled")
    return both.select(*keys, state.alias("state"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    Right rows at the same time: the greatest values count. Left rows before any right row get nulls; null keys meet.
    Both sides are written once in range partitions by key and time, so a hot key is many tasks; a partition takes the last
    right row of those before it from a table of a row for each partition and key. The write is a job of its own.
    """
    packed = F.struct(F.col(right_time).alias("t"), *values)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    a = left.select(*named, F.col(left_time).alias("_t"), F.struct("*").alias("_row"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*named, F.col(right_time).alias("_t"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"), packed.alias("_v"), F.lit(0).alias("_side"))
    spread = a.unionByName(b).repartitionByRange(*ks, "_t", "_side").withColumn("_part", F.spark_partition_id())
    spread = Scratch(left.sparkSession, "asof").save(spread, "ranges")
    upto = Window.partitionBy("_part", *ks).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn("_last", F.max("_v").over(upto)).where("_side = 1")
    lasts = spread.groupBy("_part", *ks).agg(F.max("_v").alias("_best"), F.min(F.struct("_t", "_side")).alias("_low"))
    carried = F.max("_best").over(Window.partitionBy(*ks).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"{k}b") for k in ks), carried.alias("_carried")).where("_carried is not null")
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}b")) for k in ks), F.col("_part") == F.col("_p"))
    found = local.join(lasts, on, "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select("_row.*", F.col("_last.t").alias(right_time), *(F.col(f"_last.{v}").alias(v) for v in values))
