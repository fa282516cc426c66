"""Calls of a trace replayed in order against the rules of a live run, and the turns that must not be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def replayed(calls: DataFrame, limits: dict[str, int], finish: str) -> DataFrame:
    """(case, place, issue) of every call; ``issue`` is empty where the run would have taken it.

    calls (case, place, tool, route, code, masked), a place for each call of a case: ``code`` says why a call cannot be made (empty for one
    that can), ``masked`` ones are left out of the run. The others are taken in order, unless, in this order, the run is
    finished, one of the same tool and route was taken, or as many of the tool were taken as its limit allows. A taken call of ``finish``
    finishes the run. A null route is a route of its own tool's.

    No state is carried from call to call. Only the first call of a route can be taken, as a first one that its limit turns
    away leaves the limit reached; of a tool's first calls the earliest up to its limit are taken; and what comes after the earliest
    taken finish was not. So a case of any size is aggregates and a bounded number of rows for each tool.
    """
    route = F.struct("tool", F.coalesce(F.col("route"), F.lit("")).alias("route"))
    made = calls.select("case", "place", "tool", route.alias("route"), "code", F.coalesce("masked", F.lit(False)).alias("masked"))
    live = made.where("code = '' and not masked")
    first = live.groupBy("case", "route").agg(F.min("place").alias("place")).withColumn("tool", F.col("route.tool"))
    bounds = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.create_map().cast("map<string,int>")
    most = F.try_element_at(bounds, F.col("tool"))
    place = F.row_number().over(Window.partitionBy("case", "tool").orderBy("place"))
    # the constant bound lets each task keep that many calls of a tool before they are sorted together
    top = max(limits.values(), default=0)
    held = first.where(most.isNotNull()).withColumn("k", place).where(F.col("k") <= top).where(F.col("k") <= most).select("case", "route", "place")
    taken = held.unionByName(first.where(most.isNull()).select("case", "route", "place"))
    ends = taken.where(F.col("route.tool") == finish).groupBy("case").agg(F.min("place").alias("end"))
    taken = taken.select("case", "route", F.col("place").alias("taken"))
    rows = made.join(ends, "case", "left").join(taken, ["case", "route"], "left")
    issue = (
        F.when(F.col("code") != "", F.col("code"))
        .when(F.col("masked"), "preexisting_mask")
        .when(F.col("place") > F.col("end"), "after_finish_investigation")
        .when(F.col("place") == F.col("taken"), "")
        .when(F.col("place") > F.col("taken"), "semantic_duplicate")
        .otherwise("tool_budget_exceeded")
    )
    return rows.select("case", "place", issue.alias("issue"))


def learned(messages: DataFrame, issues: DataFrame, role: str = "role", loss: Column | None = None) -> DataFrame:
    """(case, place, loss) of every message: none for a call with an issue, nor for the assistant turn right before it.

    messages (case, place, ``role``) with places that count by one; ``loss`` is what each had, true unless given. Calls masked before
    stay so, and leave the turn before them alone.
    """
    wrong = issues.where("issue <> ''")
    gone = wrong.select("case", "place", F.lit("tool_call").alias("role")).unionByName(wrong.where("issue <> 'preexisting_mask'").select("case", (F.col("place") - 1).alias("place"), F.lit("assistant").alias("role")))
    had = messages.select("case", "place", F.col(role).alias("role"), F.coalesce(loss if loss is not None else F.lit(True), F.lit(True)).alias("had"))
    rows = had.join(gone.distinct().withColumn("gone", F.lit(True)), ["case", "place", "role"], "left")
    return rows.select("case", "place", (F.col("had") & F.col("gone").isNull()).alias("loss"))
