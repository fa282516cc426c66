"""Trace scores: orders as traces, their lines as steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import scoring
from tracewright.plans.registry import load, query


@query("""
WITH s AS (SELECT l_orderkey AS trace, l_linenumber AS place, l_partkey AS id, CASE WHEN l_discount < 0.02 THEN 'current_time' WHEN l_discount < 0.09 THEN 'search' END AS tool,
  CASE WHEN l_tax > 0.07 THEN 'malformed' WHEN l_returnflag = 'R' THEN 'error' ELSE 'success' END AS status, l_quantity < 10 AS no_match, l_linestatus = 'O' AS judged FROM lineitem),
t AS (SELECT o_orderkey AS trace, CASE o_orderstatus WHEN 'F' THEN 'real' WHEN 'O' THEN 'fake' ELSE 'unverifiable' END AS expected,
  CASE WHEN o_totalprice < 150000 THEN 'real' WHEN o_totalprice < 400000 THEN 'fake' END AS verdict, left(o_orderpriority, 1) <> '5' AS finished FROM orders),
l AS (SELECT trace, list(id ORDER BY place, id) FILTER (WHERE price > 20000) AS basis, list(id ORDER BY place, id) FILTER (WHERE price > 45000) AS cited
      FROM (SELECT l_orderkey AS trace, l_linenumber AS place, l_partkey AS id, l_extendedprice AS price FROM lineitem) GROUP BY 1),
j AS (SELECT trace, max(place) AS judged_at FROM s WHERE judged GROUP BY 1),
c AS (SELECT s.trace, count(tool) AS actions, count(tool) FILTER (WHERE status = 'error') AS errors, count(tool) FILTER (WHERE status = 'malformed') AS malformed,
  count(tool) FILTER (WHERE status = 'success' AND no_match) AS empty_searches, count(*) FILTER (WHERE tool = 'current_time') AS low_value,
  count(tool) FILTER (WHERE place > judged_at) AS post_actions, list(id ORDER BY place, id) FILTER (WHERE tool IS NOT NULL AND status = 'success') AS good, any_value(judged_at) AS judged_at
  FROM s LEFT JOIN j USING (trace) GROUP BY 1),
a AS (SELECT trace, expected, verdict, finished, coalesce(actions, 0) AS actions, coalesce(errors, 0) AS errors, coalesce(malformed, 0) AS malformed, coalesce(empty_searches, 0) AS empty_searches,
  coalesce(low_value, 0) AS low_value, coalesce(post_actions, 0) AS post_actions, judged_at, coalesce(good, []) AS good, coalesce(basis, []) AS basis, coalesce(cited, []) AS cited
  FROM t LEFT JOIN c USING (trace) LEFT JOIN l USING (trace)),
e AS (SELECT *, NOT finished OR malformed > 0 OR verdict IS NULL AS engineering_error, basis = good AS basis_aligned,
  len(list_distinct(cited)) = len(cited) AND len(list_filter(cited, lambda x: NOT list_contains(good, x))) = 0 AS citation_valid, judged_at IS NOT NULL AND post_actions = 0 AS stopped_well FROM a),
r AS (SELECT *, NOT engineering_error AND expected = verdict AS result_correct FROM e),
x AS (SELECT *, list_filter([CASE WHEN NOT result_correct THEN 'incorrect_result' END, CASE WHEN engineering_error THEN 'engineering_error' END, CASE WHEN NOT basis_aligned THEN 'verdict_basis_misaligned' END,
  CASE WHEN NOT citation_valid THEN 'verdict_observation_citation_invalid' END, CASE WHEN post_actions > 0 THEN 'actions_after_judgment' END], lambda v: v IS NOT NULL) AS reasons,
  CASE WHEN malformed > 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS protocol_penalty, round(0.0::DOUBLE - 0.25 * least(1.0::DOUBLE, actions / 24.0::DOUBLE), 6) AS cost_penalty FROM r)
SELECT trace, actions, errors, malformed, empty_searches, post_actions, engineering_error, result_correct, basis_aligned, citation_valid, stopped_well,
  round(CASE WHEN actions > 0 THEN low_value / actions ELSE 0 END, 6)::DOUBLE AS low_value_rate, protocol_penalty, cost_penalty,
  round(result_correct::INT + citation_valid::INT + stopped_well::INT + protocol_penalty + cost_penalty, 6) AS total, reasons, len(reasons) = 0 AS eligible FROM x""")
def process_scores(spark, sf_dir):
    """An order's lines as a trace's steps: result, citation, stop, protocol and cost, and what keeps it from training."""
    lines = load(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_tax") > 0.07, "malformed").when(F.col("l_returnflag") == "R", "error").otherwise("success")
    steps = lines.select(
        F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("id"), F.when(F.col("l_discount") < 0.02, "current_time").when(F.col("l_discount") < 0.09, "search").alias("tool"),
        status.alias("status"), (F.col("l_quantity") < 10).alias("no_match"), (F.col("l_linestatus") == "O").alias("judged"),
    )
    priced = lambda least: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_extendedprice") > least, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"])
    lists = lines.groupBy(F.col("l_orderkey").alias("trace")).agg(priced(20000).alias("basis"), priced(45000).alias("cited"))
    expected = F.when(F.col("o_orderstatus") == "F", "real").when(F.col("o_orderstatus") == "O", "fake").otherwise("unverifiable")
    verdict = F.when(F.col("o_totalprice") < 150000, "real").when(F.col("o_totalprice") < 400000, "fake")
    traces = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace"), expected.alias("expected"), verdict.alias("verdict"), (F.substring("o_orderpriority", 1, 1) != "5").alias("finished"))
    return scoring.process_scores(traces.join(lists, "trace", "left"), steps, ["current_time"])
