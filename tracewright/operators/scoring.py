"""Scores of whole traces from their steps, in joins and combined aggregates; no trace's steps are gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.select import global_rank

# Fixed values
COST_WEIGHT, COST_ACTIONS = 0.25, 24.0
VERDICTS = ["real", "fake"]


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``position``, from 0, in their group by an order; a hot group is ranked in many tasks."""
    ranked = global_rank(rows.withColumn("_at", F.struct(group, *order)), "_at").drop("_at")
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("rank").alias("_first"))
    found = ranked.join(first, ranked[group].eqNullSafe(first["_g"]))
    return found.withColumn("position", F.col("rank") - F.col("_first")).drop("rank", "_g", "_first")


def _listed(traces: DataFrame, ids: str) -> DataFrame:
    return traces.select("trace", F.posexplode(ids).alias("position", "id"))


def process_scores(traces: DataFrame, steps: DataFrame, low_value_tools: list[str]) -> DataFrame:
    """Components, total, and the reasons that keep a trace from training.

    ``traces`` is (trace, expected, verdict, finished, basis, cited), a row each; ``steps`` is (trace, place, id, tool,
    status, no_match, judged) with status success, error or malformed; a null tool is no action, ``judged`` marks a
    judgment's output. A trace is aligned when its basis lists just its successful ids in order (equal places: by id), and its citations are
    valid when they are distinct and successful. A trace without steps, and lists that are null, count as empty.
    """
    acted, good = F.col("tool").isNotNull(), (F.col("status") == "success") & F.col("id").isNotNull()
    steps = steps.where("trace is not null")
    counts = steps.groupBy("trace").agg(
        F.count_if(acted).alias("actions"), F.count_if(acted & (F.col("status") == "error")).alias("errors"),
        F.count_if(acted & (F.col("status") == "malformed")).alias("malformed"), F.count_if(acted & good & F.col("no_match")).alias("empty_searches"),
        F.count_if(F.col("tool").isin(low_value_tools)).alias("low_value"), F.count_if(acted & good).alias("successful"),
        F.max(F.when(F.col("judged"), F.col("place"))).alias("judged_at"),
    )
    late = steps.join(counts.where("judged_at is not null").select("trace", "judged_at"), "trace").where(acted & (F.col("place") > F.col("judged_at")))
    late = late.groupBy("trace").agg(F.count("*").alias("post_actions"))
    found = placed(steps.where(acted & good).select("trace", "place", "id"), "trace", ["place", "id"])
    basis = _listed(traces, "basis").join(found.select("trace", "position", "id"), ["trace", "position", "id"]).groupBy("trace").agg(F.count("*").alias("in_place"))
    cited = _listed(traces, "cited").select("trace", "id").distinct().join(found.select("trace", "id").distinct(), ["trace", "id"])
    cited = cited.groupBy("trace").agg(F.count("*").alias("held"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    rows = traces.withColumns({"n_basis": size("basis"), "n_cited": size("cited")}).drop("basis", "cited")
    rows = reduce(lambda a, b: a.join(b, "trace", "left"), (counts, late, basis, cited), rows)
    numbers = ["actions", "errors", "malformed", "empty_searches", "low_value", "successful", "post_actions", "in_place", "held"]
    rows = rows.na.fill(0, numbers)
    known = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumn("engineering_error", ~known(F.col("finished")) | (F.col("malformed") > 0) | ~known(F.col("verdict").isin(VERDICTS)))
    rows = rows.withColumns({
        "result_correct": ~F.col("engineering_error") & known(F.col("expected").isin(VERDICTS) & (F.col("expected") == F.col("verdict"))),
        "basis_aligned": (F.col("n_basis") == F.col("successful")) & (F.col("in_place") == F.col("successful")),
        "citation_valid": F.col("held") == F.col("n_cited"),
        "stopped_well": F.col("judged_at").isNotNull() & (F.col("post_actions") == 0),
    })
    one = lambda c: c.cast("double")
    cost = F.round(0.0 - COST_WEIGHT * F.least(F.lit(1.0), F.col("actions") / COST_ACTIONS), 6)
    protocol = F.when(F.col("malformed") > 0, -1.0).otherwise(0.0)
    total = one(F.col("result_correct")) + one(F.col("citation_valid")) + one(F.col("stopped_well")) + protocol + cost
    reasons = reasons_of({
        "incorrect_result": ~F.col("result_correct"), "engineering_error": F.col("engineering_error"), "verdict_basis_misaligned": ~F.col("basis_aligned"),
        "verdict_observation_citation_invalid": ~F.col("citation_valid"), "actions_after_judgment": F.col("post_actions") > 0,
    })
    return rows.select(
        "trace", "actions", "errors", "malformed", "empty_searches", "post_actions", "engineering_error", "result_correct", "basis_aligned", "citation_valid", "stopped_well",
        F.round(F.coalesce(F.try_divide(F.col("low_value"), F.col("actions")), F.lit(0.0)), 6).alias("low_value_rate"),
        protocol.alias("protocol_penalty"), cost.alias("cost_penalty"), F.round(total, 6).alias("total"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"),
    )


def reasons_of(broken: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for name, c in broken.items())))
