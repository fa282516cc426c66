"""Catalogues of kept and rejected rows: each row once, whatever key it is known by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.session import Scratch


def first_free(rows: DataFrame, order: list[Column], keys: list[Column]) -> DataFrame:
    """The rows that stay when they are taken in order and one goes that shares a key with a row that stayed.

    ``order`` tells all rows apart. Blank and null keys are none. A row that goes holds no key against later rows, so the result is
    not one row of each connected group. What a loop over all rows gives is found in rounds: a row that is the first left under each of its
    keys stays, those that share a key with it go. Each round is two aggregations by key and written tables of (order, keys);
    a key of any number of rows is combined before it is shuffled.
    """
    scratch = Scratch(rows.sparkSession, "catalogue")
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    named = F.array_distinct(F.array_compact(F.array(*(F.nullif(F.trim(k.cast("string")), F.lit("")) for k in keys))))
    left = scratch.save(rows.select(place.alias("at"), named.alias("keys")), "left")
    stayed = []
    while not left.isEmpty():
        each = left.select("at", F.explode("keys").alias("key"))
        low = each.groupBy("key").agg(F.min("at").alias("low"))
        own = each.join(low, "key").groupBy("at").agg(F.bool_and(F.col("at") == F.col("low")).alias("first")).where("first").select("at")
        own = scratch.save(own.union(left.where("size(keys) = 0").select("at")), "stayed")
        taken = each.join(own, "at", "left_semi").select("key").distinct()
        gone = each.join(taken, "key", "left_semi").select("at").distinct().union(own)
        rest = scratch.save(left.join(gone, "at", "left_anti"), "left")
        scratch.drop(left)
        left = rest
        stayed.append(own)
    out = rows.withColumn("_at", place)
    if not stayed:
        return out.drop("_at")
    kept = stayed[0]
    for more in stayed[1:]:
        kept = kept.union(more)
    return out.join(kept.withColumnRenamed("at", "_at"), "_at", "left_semi").drop("_at")
