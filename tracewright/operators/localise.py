"""Where a trace failed, and what a hint gives away: aggregates over long tables, whatever the size of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.evidence import MODEL_STAGES, UNUSABLE
from tracewright.functions.text import normalise

# Words that tell a verdict, and names of what a hint's writer alone may see
VERDICTS = r"(?i)(?<![\w-])(?:real|fake|true|false)(?![\w-])|真实|伪造|真图|假图"
INTERNAL = r"(?i)\b(?:ground[\s_-]*truth|private[\s_-]*gold|expected[\s_-]*verdict|reference[\s_-]*fact|acceptable[\s_-]*evidence)\b"


def failure_anchors(steps: DataFrame, audits: DataFrame) -> DataFrame:
    """(case, basis, place, source_index, attributed): the step from which a failed trace is to be repaired.

    steps (case, place, source_index, rejected, judgment), audits (case, number, location). In this order: the step of the first audit
    that names one of the case's steps as ``all_steps[i]``, the first rejected step, the first judgment, the last step; only the first two are
    attributed. Of steps with one source index the first counts. Cases without steps have no row.
    """
    step = F.struct("place", "source_index")
    named = audits.select("case", "number", F.regexp_extract(F.coalesce("location", F.lit("")), r"all_steps\[([0-9]+)\]", 1).alias("i")).where("i <> ''")
    firsts = steps.groupBy("case", "source_index").agg(F.min("place").alias("place"))
    located = named.join(firsts, (named["case"] == firsts["case"]) & (named["i"].cast("long") == firsts["source_index"])).select(named["case"], "number", "place", "source_index")
    audited = located.groupBy("case").agg(F.min_by(step, F.struct("number", "place")).alias("audited"))
    least = lambda holds: F.min(F.when(holds, step))
    seen = steps.groupBy("case").agg(least(F.col("rejected")).alias("rejected"), least(F.col("judgment")).alias("judged"), F.max(step).alias("last"))
    rows = seen.join(audited, "case", "left")
    basis = F.when(F.col("audited").isNotNull(), "strict_trace_audit_location").when(F.col("rejected").isNotNull(), "first_protocol_rejection").otherwise("terminal_outcome_or_unlocated_audit_failure")
    at = F.coalesce("audited", "rejected", "judged", "last")
    return rows.select("case", basis.alias("basis"), at["place"].alias("place"), at["source_index"].alias("source_index"), (basis != "terminal_outcome_or_unlocated_audit_failure").alias("attributed"))


def audited_hints(hints: DataFrame, private: DataFrame, verdicts: str = VERDICTS, internal: str = INTERNAL, longest: int = 1200, shortest: int = 4) -> DataFrame:
    """(id, passed, errors, leak_paths) of every hint.

    hints (id, hint, level), private (id, path, value, tool): what a hint must not say, ``tool`` ones only at levels 1 and 2. A value of
    fewer than ``shortest`` characters gives nothing away. Texts are compared in lower case with white space compressed.
    ``verdicts`` and ``internal`` are patterns of words that no hint may hold. Errors and paths are sorted, each once.
    """
    text = F.trim(F.coalesce("hint", F.lit("")))
    rows = hints.select("id", text.alias("hint"), F.coalesce(F.col("level"), F.lit(0)).alias("level"))
    said = private.select("id", "path", normalise(F.col("value")).alias("value"), "tool").where(F.char_length("value") >= shortest).distinct()
    leaks = rows.select("id", "level", normalise(F.col("hint")).alias("text")).join(said, "id").where(F.contains("text", F.col("value")) & (~F.col("tool") | (F.col("level") <= 2)))
    leaks = leaks.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("leak_paths"))
    found: dict[str, Column] = {
        "binary_verdict_leak": F.col("hint").rlike(verdicts), "hint_empty": F.col("hint") == "", "hint_level_invalid": ~F.col("level").isin(1, 2, 3, 4), "hint_too_long": F.char_length("hint") > longest,
        "internal_term_leak": F.col("hint").rlike(internal), "private_value_leak": F.col("leak_paths").isNotNull(),
    }
    errors = F.array_compact(F.array(*(F.when(holds, name) for name, holds in found.items())))
    out = rows.join(leaks, "id", "left").withColumn("errors", errors)
    return out.select("id", (F.size("errors") == 0).alias("passed"), "errors", F.coalesce("leak_paths", F.array().cast("array<string>")).alias("leak_paths"))


def repairable_failures(traces: DataFrame, receipts: DataFrame, captures: DataFrame) -> DataFrame:
    """(case) of traces that ended in an unusable model action after a prefix whose tokens were captured whole.

    traces (case, termination, error), receipts (case, error, status, stage), captures (case, status, ids, logprobs). The error must be
    of the one known form and be told by a receipt of a model's stage; there must be captures, and all of them complete, with a finite
    log probability for each token and one at least. They seed repairs; nothing is said about the cause.
    """
    ended = traces.where((F.col("termination") == "error") & F.col("error").rlike(UNUSABLE)).select("case", "error")
    told = receipts.where((F.col("status") == "error") & F.lower(F.coalesce("stage", F.lit(""))).isin(MODEL_STAGES)).select("case", "error")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    whole = (F.col("status") == "complete") & (F.size("logprobs") > 0) & (F.size("logprobs") == F.size("ids")) & F.forall("logprobs", finite)
    intact = captures.groupBy("case").agg(F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole")).where("whole")
    return ended.join(told, ["case", "error"], "left_semi").join(intact, "case", "left_semi").select("case").distinct()
