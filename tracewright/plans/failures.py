"""Failed traces and hints: orders as traces, conversations as hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import localise
from tracewright.plans.evidence import answered
from tracewright.plans.registry import load, query


@query("""
WITH s AS (SELECT l_orderkey AS k, (l_linenumber, l_partkey, l_suppkey) AS place, l_linenumber AS i, l_tax > 0.07 AS rejected, l_linestatus = 'F' AS judgment FROM lineitem),
a AS (SELECT o_orderkey AS k, n AS number, 'report: state.all_steps[' || (o_custkey // n) % 9 || '].tool' AS location FROM orders, (VALUES (1), (7)) v(n) WHERE o_orderpriority < '3'),
h AS (SELECT s.k, first(s.place ORDER BY number, s.place) AS place FROM a JOIN s ON s.k = a.k AND s.i = regexp_extract(location, '\\[(\\d+)\\]', 1)::INT GROUP BY 1),
g AS (SELECT k, min(place) FILTER (WHERE rejected) AS r, min(place) FILTER (WHERE judgment) AS j, max(place) AS last FROM s GROUP BY 1),
o AS (SELECT g.k, CASE WHEN h.place IS NOT NULL THEN 'strict_trace_audit_location' WHEN r IS NOT NULL THEN 'first_protocol_rejection' ELSE 'terminal_outcome_or_unlocated_audit_failure' END AS basis, coalesce(h.place, r, j, last) AS at_ FROM g LEFT JOIN h USING (k))
SELECT k AS "case", basis, at_[1] AS source_index, at_[2] AS part, at_[3] AS supplier, basis NOT LIKE 'terminal%' AS attributed FROM o""")
def failure_anchors(spark, sf_dir):
    """The step from which an order's trace is to be repaired; two audits of the urgent ones name a line each."""
    steps = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.col("l_linenumber").alias("source_index"), (F.col("l_tax") > 0.07).alias("rejected"), (F.col("l_linestatus") == "F").alias("judgment")
    )
    named = lambda n: F.struct(F.lit(n).alias("number"), F.concat(F.lit("report: state.all_steps["), F.pmod(F.floor(F.col("o_custkey") / n), F.lit(9)).cast("string"), F.lit("].tool")).alias("location"))
    audits = load(spark, sf_dir, "orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("case"), F.explode(F.array(named(1), named(7))).alias("a")).select("case", "a.*")
    out = localise.failure_anchors(steps, audits)
    return out.select("case", "basis", "source_index", F.col("place.l_partkey").alias("part"), F.col("place.l_suppkey").alias("supplier"), "attributed")


@query(r"""
WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT conv_id * 1000 + turn AS id, trim(CASE WHEN turn % 8 = 0 THEN coalesce(text, '') || ' Is it true?' ELSE coalesce(text, '') END) AS hint, turn % 6 AS level, answer FROM t WHERE role = 'user' AND who = 'assistant'),
c AS (SELECT id, unnest(string_split_regex(coalesce(answer, ''), '[.,\n]')) AS value, generate_subscripts(string_split_regex(coalesce(answer, ''), '[.,\n]'), 1) - 1 AS i FROM h),
p AS (SELECT id, 'private.' || i AS path, value, i % 3 = 0 AS tool FROM c),
n AS (SELECT *, lower(regexp_replace(regexp_replace(value, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS v FROM p),
l AS (SELECT h.id, list_sort(list(DISTINCT path)) AS paths FROM h JOIN n USING (id) WHERE length(v) >= 4 AND contains(lower(regexp_replace(regexp_replace(hint, '\s+', ' ', 'g'), '^ | $', '', 'g')), v) AND (NOT tool OR level <= 2) GROUP BY 1),
e AS (SELECT h.id, coalesce(paths, []::VARCHAR[]) AS leak_paths, list_filter([CASE WHEN regexp_matches(hint, '(?i)(^|[^\w-])(real|fake|true|false)($|[^\w-])') THEN 'binary_verdict_leak' END, CASE WHEN hint = '' THEN 'hint_empty' END,
  CASE WHEN level NOT BETWEEN 1 AND 4 THEN 'hint_level_invalid' END, CASE WHEN length(hint) > 1200 THEN 'hint_too_long' END, CASE WHEN paths IS NOT NULL THEN 'private_value_leak' END], lambda x: x IS NOT NULL) AS errors FROM h LEFT JOIN l USING (id))
SELECT id, len(errors) = 0 AS passed, errors, leak_paths FROM e""")
def audited_hints(spark, sf_dir):
    """User turns as hints, the clauses of the answers after them as what they must not say; every eighth turn asks for a verdict."""
    turns = answered(load(spark, sf_dir, "conversations")).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    text = F.coalesce("text", F.lit(""))
    hints = turns.select("id", F.when(F.pmod("turn", F.lit(8)) == 0, F.concat(text, F.lit(" Is it true?"))).otherwise(text).alias("hint"), F.pmod("turn", F.lit(6)).cast("int").alias("level"))
    clauses = turns.select("id", F.posexplode(F.split(F.coalesce("answer", F.lit("")), r"[.,\n]")).alias("i", "value"))
    return localise.audited_hints(hints, clauses.select("id", F.concat(F.lit("private."), F.col("i").cast("string")).alias("path"), "value", (F.pmod("i", F.lit(3)) == 0).alias("tool")))
