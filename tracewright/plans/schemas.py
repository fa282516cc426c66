"""Calls against their tools' schemas: an order's lines as calls, whose shapes come from the lines' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import schema
from tracewright.operators import replay
from tracewright.operators.select import global_rank
from tracewright.plans.registry import load, query

QUERIES = {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 6}}
TOOLS = {
    "text_search": [
        {"properties": {"queries": {"type": "string", "maxLength": 9}, "top_k": {"type": "integer"}}, "required": ["queries"]},
        {"properties": {"queries": QUERIES, "mode": {"type": "string", "enum": ["Fast", "deep"]}}, "required": ["queries", "mode"]},
    ],
    "visit": [{"properties": {"url": {"type": "array", "items": {"type": "string"}}, "goal": {"type": "string"}}, "required": ["url", "goal"]}],
    "check_consistency": [
        {
            "properties": {"aspect": {"type": "string", "enum": ["physics", "light"]}, "share": {"type": "number"}, "options": {"type": "object", "properties": {"deep": {"type": "boolean"}, "size": {"type": "integer"}}, "required": ["deep"], "additionalProperties": False}},
            "required": ["aspect"],
        }
    ],
}


def calls(spark, sf_dir):
    """(l_orderkey, l_linenumber, tool, arguments): a tool by the return flag, its arguments' shapes by tax, discount, quantity and status."""
    part, quantity, tax, discount = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    text = F.concat(F.lit('"part '), part, F.lit('"'))
    queries = F.when(tax < 3, text).when(tax < 6, F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.concat(F.lit("["), text, F.lit(', "x"]')))
    search = F.concat(F.lit('{"queries": '), queries, F.when(discount < 4, F.concat(F.lit(', "top_k": '), quantity.cast("string"))).when(discount < 8, ', "mode": "FAST"').otherwise(', "zone": 1, "area": null'), F.lit("}"))
    visit = F.concat(F.lit('{"url": '), F.when(tax < 4, text).otherwise(F.concat(F.lit("["), text, F.lit(", "), quantity.cast("string"), F.lit("]"))), F.when(discount < 6, ', "goal": "look"').otherwise(""), F.lit("}"))
    aspect = F.when(tax < 2, '"Physics"').when(tax < 4, '"physical_consistency"').when(tax < 6, '"light"').otherwise('"shade"')
    options = F.when(discount < 3, '{"deep": true}').when(discount < 5, '{"deep": 1, "size": 2}').when(discount < 7, '{"size": 2}').otherwise('{"deep": false, "b": 1, "a": 2}')
    check = F.concat(F.lit('{"aspect": '), aspect, F.lit(', "share": '), F.when(quantity < 25, F.concat(quantity.cast("string"), F.lit(".5"))).otherwise("true"), F.lit(', "options": '), options, F.lit("}"))
    rows = load(spark, sf_dir, "lineitem")
    tool = F.when(F.col("l_returnflag") == "R", "text_search").when(F.col("l_returnflag") == "A", "visit").otherwise("check_consistency")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", tool.alias("tool"), F.when(tool == "text_search", search).when(tool == "visit", visit).otherwise(check).alias("arguments"))


SHAPES = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag, l_quantity::INT AS q, round(l_tax * 100)::INT AS t, round(l_discount * 100)::INT AS d, 'part ' || l_partkey AS p FROM lineitem),
k AS (
  SELECT *, CASE flag WHEN 'R' THEN 'text_search' WHEN 'A' THEN 'visit' ELSE 'check_consistency' END AS tool,
    -- the issues under the last schema of each tool, in order
    CASE flag
      WHEN 'R' THEN list_concat(CASE WHEN d < 4 THEN ['unknown_argument:top_k'] WHEN d >= 8 THEN ['unknown_argument:area', 'unknown_argument:zone'] ELSE []::VARCHAR[] END, CASE WHEN d BETWEEN 4 AND 7 THEN []::VARCHAR[] ELSE ['missing_required:mode'] END,
        CASE WHEN t < 3 THEN ['invalid_type:queries'] WHEN t >= 6 OR length(p) < 6 THEN ['invalid_value:queries[]'] ELSE []::VARCHAR[] END, CASE WHEN d BETWEEN 4 AND 7 THEN ['invalid_enum:mode'] ELSE []::VARCHAR[] END)
      WHEN 'A' THEN list_concat(CASE WHEN d >= 6 THEN ['missing_required:goal'] ELSE []::VARCHAR[] END, CASE WHEN t < 4 THEN ['invalid_type:url'] ELSE ['invalid_type:url[]'] END)
      ELSE list_concat(CASE WHEN t < 4 OR t >= 6 THEN ['invalid_enum:aspect'] ELSE []::VARCHAR[] END, CASE WHEN q < 25 THEN []::VARCHAR[] ELSE ['invalid_type:share'] END,
        CASE WHEN d < 3 THEN []::VARCHAR[] WHEN d < 5 THEN ['invalid_type:options.deep'] WHEN d < 7 THEN ['nested_missing_required:options.deep'] ELSE ['nested_unknown_argument:options.a'] END) END AS issues
  FROM c)"""


@query(f"""WITH {SHAPES}
SELECT l_orderkey, l_linenumber, l_partkey, string_split(issue, ':')[1] AS code, string_split(issue, ':')[2] AS path, (i - 1)::INT AS place
FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(issues) AS issue, generate_subscripts(issues, 1) AS i FROM k)""")
def schema_issues(spark, sf_dir):
    """Every issue of every call under the last schema of its tool: names, types, bounds, enums, nested arrays and objects."""
    rows = calls(spark, sf_dir).withColumn("given", F.from_json("arguments", "map<string,variant>"))
    found = schema.by_name(F.col("tool"), {tool: schema.schema_issues(tool, F.col("given"), schemas[-1]) for tool, schemas in TOOLS.items()}, f"array<{schema.ISSUE}>")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode(found).alias("place", "i")).select("l_orderkey", "l_linenumber", "l_partkey", "i.code", "i.path", "place")


@query(f"""WITH {SHAPES},
s AS (
  SELECT *, -- under the first schema of text_search, and what mends a call under either
    flag = 'R' AND t < 3 AND length(p) <= 9 AS text_fits, flag = 'R' AND t BETWEEN 3 AND 5 AND length(p) <= 9 AS one_fits, flag = 'R' AND t BETWEEN 3 AND 5 AND length(p) >= 6 AND d BETWEEN 4 AND 7 AS list_fits,
    flag = 'A' AND d < 6 AND t < 4 AS url_fits, flag NOT IN ('R', 'A') AND q < 25 AND d < 3 AND t < 6 AS check_fits,
    CASE WHEN d < 4 THEN []::VARCHAR[] WHEN d < 8 THEN ['mode'] ELSE ['area', 'zone'] END AS extra FROM k),
f AS (
  SELECT *, CASE WHEN text_fits AND len(extra) = 0 OR check_fits AND t >= 4 THEN 'exact' WHEN list_fits OR url_fits OR check_fits THEN 'safe_value_normalized' WHEN one_fits AND len(extra) = 0 THEN 'safe_value_normalized'
    WHEN one_fits THEN 'safe_projection' WHEN text_fits THEN 'unknown_arguments_removed' ELSE 'unrepairable' END AS status FROM s),
u AS (
  SELECT *, CASE WHEN flag <> 'R' THEN (CASE WHEN flag = 'A' AND t < 4 THEN ['missing_required:goal'] WHEN flag NOT IN ('R', 'A') AND t < 4 THEN list_filter(issues, lambda x: x <> 'invalid_enum:aspect') ELSE issues END)
    ELSE ( -- the fewer issues of the two schemas once mended, as (number, codes and fields)
      SELECT min_by(i, (len(i), list_transform(i, lambda x: string_split(x, ':')))) FROM (VALUES
        (CASE WHEN t < 6 THEN (CASE WHEN length(p) > 9 THEN ['invalid_value:queries'] ELSE []::VARCHAR[] END) ELSE ['invalid_type:queries'] END),
        (list_concat(CASE WHEN d BETWEEN 4 AND 7 THEN []::VARCHAR[] ELSE ['missing_required:mode'] END, CASE WHEN t < 3 THEN ['invalid_type:queries'] WHEN t >= 6 OR length(p) < 6 THEN ['invalid_value:queries[]'] ELSE []::VARCHAR[] END))) v(i)) END AS rest FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, tool, status,
  CASE WHEN status IN ('safe_projection', 'unknown_arguments_removed') THEN extra ELSE []::VARCHAR[] END AS removed,
  CASE WHEN status = 'safe_projection' OR status = 'safe_value_normalized' AND one_fits AND NOT list_fits THEN ['queries:singleton_array_to_string'] WHEN status <> 'safe_value_normalized' THEN []::VARCHAR[]
    WHEN list_fits THEN ['mode:enum_case_normalized'] WHEN url_fits THEN ['url:string_to_singleton_array'] WHEN t < 2 THEN ['aspect:enum_case_normalized'] ELSE ['aspect:physical_consistency_to_physics'] END AS changes,
  CASE WHEN status = 'unrepairable' THEN string_split(rest[1], ':')[1] ELSE '' END AS code, CASE WHEN status = 'unrepairable' THEN list_transform(rest, lambda x: string_split(x, ':')[2]) ELSE []::VARCHAR[] END AS fields
FROM u""")
def repaired_calls(spark, sf_dir):
    """What the cheapest repair under its tool's schemas makes of every call."""
    out = calls(spark, sf_dir).withColumn("r", schema.project_call(F.col("tool"), F.col("arguments"), TOOLS))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "tool", "r.status", "r.removed", "r.changes", "r.code", "r.fields")


LIMITS = {"view": 6, "click": 3}
LIVE = """c AS (
  SELECT user_id AS "case", 2 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS place, event_type AS tool, event_type || ':' || coalesce(props, '') AS route,
         CASE WHEN value < 1 THEN 'missing_required' ELSE '' END AS code, value > 60 AS masked FROM events),
f AS (SELECT "case", route, tool, min(place) AS place FROM c WHERE code = '' AND NOT masked GROUP BY ALL),
t AS (SELECT *, CASE tool WHEN 'view' THEN 6 WHEN 'click' THEN 3 ELSE 1000000 END AS most, (SELECT count(*) FROM f g WHERE g."case" = f."case" AND g.tool = f.tool AND g.place <= f.place) AS k FROM f),
e AS (SELECT "case", min(place) AS ends FROM t WHERE k <= most AND tool = 'error' GROUP BY 1),
i AS (
  SELECT c."case", c.place, CASE WHEN c.code <> '' THEN c.code WHEN masked THEN 'preexisting_mask' WHEN c.place > ends THEN 'after_finish_investigation' WHEN t.k <= t.most AND c.place = t.place THEN ''
    WHEN t.k <= t.most AND c.place > t.place THEN 'semantic_duplicate' ELSE 'tool_budget_exceeded' END AS issue
  FROM c LEFT JOIN e USING ("case") LEFT JOIN t ON t."case" = c."case" AND t.route = c.route)"""


def event_calls(spark, sf_dir):
    """A user's events as a trace: each is an assistant turn and a call; small values cannot be made, large ones are masked, an error finishes."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props")
    placed = global_rank(rows.withColumn("at", F.struct("user_id", "event_id")), "at")
    starts = placed.groupBy("user_id").agg(F.min("rank").alias("start"))
    route = F.concat(F.col("event_type"), F.lit(":"), F.coalesce("props", F.lit("")))
    place = (F.col("rank") - F.col("start") + 1) * 2
    return placed.join(starts, "user_id").select(F.col("user_id").alias("case"), place.alias("place"), F.col("event_type").alias("tool"), route.alias("route"), F.when(F.col("value") < 1, "missing_required").otherwise("").alias("code"), (F.col("value") > 60).alias("masked"))


@query(f"""WITH {LIVE} SELECT * FROM i""")
def replayed_calls(spark, sf_dir):
    """Of every call whether a run with its rules on finish, duplicates and budgets would have taken it."""
    return replay.replayed(event_calls(spark, sf_dir), LIMITS, "error")


@query(f"""WITH {LIVE},
m AS (SELECT "case", place, 'tool_call' AS role, NOT masked AS had FROM c UNION ALL SELECT "case", place - 1, CASE WHEN place % 4 = 0 THEN 'user' ELSE 'assistant' END, true FROM c)
SELECT m."case", m.place, had AND NOT (role = 'tool_call' AND EXISTS (SELECT 1 FROM i WHERE i."case" = m."case" AND i.place = m.place AND issue <> ''))
  AND NOT (role = 'assistant' AND EXISTS (SELECT 1 FROM i WHERE i."case" = m."case" AND i.place = m.place + 1 AND issue NOT IN ('', 'preexisting_mask'))) AS loss FROM m""")
def replayed_loss_mask(spark, sf_dir):
    """Which messages may be learned from, once rejected calls and the assistant turns before them are masked."""
    calls = event_calls(spark, sf_dir)
    before = F.when(F.pmod("place", F.lit(4)) == 0, "user").otherwise("assistant")
    messages = calls.select("case", "place", F.lit("tool_call").alias("role"), (~F.col("masked")).alias("had")).unionByName(calls.select("case", (F.col("place") - 1).alias("place"), before.alias("role"), F.lit(True).alias("had")))
    return replay.learned(messages, replay.replayed(calls, LIMITS, "error"), loss=F.col("had"))
