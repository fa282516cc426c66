"""Schema issues and repairs: a case for each rule, and random calls against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from tracewright.functions import schema

NESTED = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "string", "enum": ["x", "y"]}}, "required": ["c"]}}}, "required": ["a"], "additionalProperties": False}
CASES = [
    ({"type": "string"}, '"x"', None), ({"type": "string"}, "5", ("invalid_type", "v")), ({"type": "string", "minLength": 2}, '" a\\t"', ("invalid_value", "v")), ({"type": "string", "maxLength": 2}, '"abc"', ("invalid_value", "v")),
    ({"type": "string", "minLength": 1}, "null", ("invalid_type", "v")), ({"type": "integer"}, "5", None), ({"type": "integer"}, "5.0", ("invalid_type", "v")), ({"type": "integer"}, "true", ("invalid_type", "v")), ({"type": "integer"}, "12345678901234567890", None),
    ({"type": "number"}, "5", None), ({"type": "number"}, "5.25", None), ({"type": "number"}, "1e9", None), ({"type": "number"}, "false", ("invalid_type", "v")), ({"type": "number"}, '"5"', ("invalid_type", "v")), ({"type": "boolean"}, "true", None),
    ({"type": "boolean"}, "1", ("invalid_type", "v")), ({"type": "array"}, "{}", ("invalid_type", "v")), ({"type": "array", "minItems": 1}, "[]", ("invalid_value", "v")), ({"type": "array", "maxItems": 1}, "[1,2]", ("invalid_value", "v")),
    ({"type": "array", "items": {"type": "integer"}}, "[1,null]", ("invalid_type", "v[]")), ({"type": "array", "items": {"type": "array", "items": {"type": "string"}}}, '[["a"],["b",3]]', ("invalid_type", "v[][]")),
    ({"enum": ["a", 1, None]}, '"b"', ("invalid_enum", "v")), ({"enum": ["a", 1, None]}, "null", None), ({"type": "string", "enum": ["a"]}, "1", ("invalid_type", "v")), ({}, "[1]", None),
    (NESTED, "[]", ("invalid_type", "v")), (NESTED, '{"a":1}', None), (NESTED, '{"z":1,"y":2}', ("nested_unknown_argument", "v.y")), (NESTED, '{"b":[]}', ("nested_missing_required", "v.a")), (NESTED, '{"a":"1"}', ("invalid_type", "v.a")),
    (NESTED, '{"a":1,"b":[{"c":"x"},{}]}', ("nested_missing_required", "v.b[].c")), (NESTED, '{"a":1,"b":[{"c":"z"}]}', ("invalid_enum", "v.b[].c")),
]


def test_first_issue_of_a_value(spark):
    for spec in {json.dumps(s): s for s, _, _ in CASES}.values():
        own = [(v, w) for s, v, w in CASES if s == spec]
        rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(own)], "i int, v string")
        got = {r.i: r.x and tuple(r.x) for r in rows.select("i", schema.value_issue(F.parse_json("v"), spec, "v").alias("x")).collect()}
        assert got == {i: w for i, (_, w) in enumerate(own)}, spec


def plain_issue(value, spec, path):
    kind = spec.get("type")
    right = {"string": lambda: isinstance(value, str), "array": lambda: isinstance(value, list), "integer": lambda: isinstance(value, int) and not isinstance(value, bool), "boolean": lambda: isinstance(value, bool)}
    if kind and not right[kind]():
        return "invalid_type", path
    if kind == "array":
        if len(value) > spec.get("maxItems", 99):
            return "invalid_value", path
        for x in value:
            if found := plain_issue(x, spec.get("items", {}), path + "[]"):
                return found
    if "enum" in spec and value not in spec["enum"]:
        return "invalid_enum", path
    return None


def plain_issues(args, s):
    found = [("unknown_argument", k) for k in sorted(set(args) - set(s["properties"]))] + [("missing_required", k) for k in s.get("required", []) if k not in args]
    return found + [x for k, v in args.items() if k in s["properties"] and (x := plain_issue(v, s["properties"][k], k))]


def plain_repair(tool, args, schemas):
    if any(not plain_issues(args, s) for s in schemas):
        return "exact", args, [], [], "", []
    mended, failed = [], []
    for s in schemas:
        gone = sorted(set(args) - set(s["properties"]))
        new, changes = {k: v for k, v in args.items() if k in s["properties"]}, []
        for k, v in list(new.items()):
            spec = s["properties"][k]
            if (tool, k) == ("text_search", "queries") and spec.get("type") == "string" and isinstance(v, list) and len(v) == 1 and isinstance(v[0], str):
                new[k] = v[0]
                changes.append(k + ":singleton_array_to_string")
            elif (tool, k) == ("visit", "url") and spec.get("type") == "array" and isinstance(v, str):
                new[k] = [v]
                changes.append(k + ":string_to_singleton_array")
            elif isinstance(v, str) and v not in spec.get("enum", [v]):
                same = [x for x in spec["enum"] if x.lower() == v.lower()]
                if len(same) == 1:
                    new[k] = same[0]
                    changes.append(k + ":enum_case_normalized")
        left = plain_issues(new, s)
        failed.append(left or plain_issues(args, s))
        if not left and (gone or changes):
            mended.append((len(gone) + len(changes), len(gone), gone, changes, new))
    if mended:
        _, _, gone, changes, new = min(mended, key=lambda m: m[:4])
        return "safe_projection" if gone and changes else "unknown_arguments_removed" if gone else "safe_value_normalized", new, gone, changes, "", []
    least = min(failed, key=lambda x: (len(x), x))
    return "unrepairable", args, [], [], least[0][0], [p for _, p in least]


TOOLS = {
    "text_search": [
        {"properties": {"queries": {"type": "string"}, "top_k": {"type": "integer"}}, "required": ["queries"]},
        {"properties": {"queries": {"type": "array", "maxItems": 2, "items": {"type": "string"}}, "mode": {"type": "string", "enum": ["Fast", "deep"]}, "top_k": {}}, "required": ["queries", "mode"]},
    ],
    "visit": [{"properties": {"url": {"type": "array", "items": {"type": "string"}}, "deep": {"type": "boolean"}, "lang": {"enum": ["en", "EN", "de"]}}, "required": ["url"]}],
}


def test_repairs_against_a_plain_walk(spark):
    rng = random.Random(3)
    values = ["a", "", ["a"], ["a", "b"], ["a", 1], [], 5, True, None, "FAST", "fast", "DEEP", "EN", "De", {"x": 1}, ["q", "r", "s"]]
    calls = [(rng.choice(["text_search", "visit"]), {k: rng.choice(values) for k in rng.sample(["queries", "top_k", "mode", "url", "deep", "lang", "zz"], rng.randrange(0, 5))}) for _ in range(500)]
    rows = spark.createDataFrame([(i, t, json.dumps(a)) for i, (t, a) in enumerate(calls)], "i int, t string, a string").repartition(2)
    got = {r.i: (r.status, json.loads(r.a), r.removed, r.changes, r.code, r.fields) for r in rows.select("i", schema.project_call(F.col("t"), F.col("a"), TOOLS).alias("r")).select("i", "r.*", F.to_json("r.arguments").alias("a")).collect()}
    assert got == {i: plain_repair(t, a, TOOLS[t]) for i, (t, a) in enumerate(calls)}
    assert {g[0] for g in got.values()} == {"exact", "safe_projection", "unknown_arguments_removed", "safe_value_normalized", "unrepairable"}


def test_tools_own_spellings_and_stand_ins(spark):
    tools = {
        "ocr_with_position": [{"properties": {"bbox": {"type": "array"}, "q": {"type": "string"}}}],
        "focused_visual_inspection": [{"properties": {"anchor_regions": {"type": "array", "maxItems": 4}, "scope": {"enum": ["integrity"]}}}],
        "crop_and_inspect": [{"properties": {"bbox": {}, "focus_question": {}, "visual_question_id": {}}, "required": ["bbox", "focus_question"]}],
    }
    box = [0, 0, 1, 0.5]
    calls = [
        ("ocr_with_position", {"bbox": None}, "safe_value_normalized", {}, ["bbox:empty_region_omitted"]),
        ("ocr_with_position", {"bbox": [], "q": "x"}, "exact", {"bbox": [], "q": "x"}, []),
        ("focused_visual_inspection", {"anchor_regions": [box] * 5, "scope": "Physics"}, "safe_value_normalized", {"anchor_regions": [box] * 4, "scope": "integrity"}, ["anchor_regions:runtime_first_four", "scope:physical_consistency_to_integrity"]),
        ("focused_visual_inspection", {"anchor_regions": [box] * 3 + [[1, 2, True, 3]] * 2}, "unrepairable", {"anchor_regions": [box] * 3 + [[1, 2, True, 3]] * 2}, []),
        ("crop_and_inspect", {"visual_question_id": "v1"}, "exact", {"visual_question_id": "v1"}, []),
        ("crop_and_inspect", {"visual_question_id": " "}, "unrepairable", {"visual_question_id": " "}, []),
    ]
    rows = spark.createDataFrame([(i, c[0], json.dumps(c[1])) for i, c in enumerate(calls)], "i int, t string, a string")
    got = {r.i: (r.status, json.loads(r.a), r.changes) for r in rows.select("i", schema.project_call(F.col("t"), F.col("a"), tools).alias("r")).select("i", "r.*", F.to_json("r.arguments").alias("a")).collect()}
    assert got == {i: c[2:] for i, c in enumerate(calls)}


def test_calls_that_are_none(spark):
    rows = spark.createDataFrame([(0, " ", "{}"), (1, None, "{}"), (2, "nope", "{}"), (3, "visit", "[1]"), (4, "visit", "{"), (5, "visit", None), (6, "visit", '{"a":1,"a":2}')], "i int, t string, a string")
    got = {r.i: (r.status, r.code) for r in rows.select("i", schema.project_call(F.col("t"), F.col("a"), TOOLS).alias("r")).select("i", "r.*").collect()}
    assert got == {i: ("unrepairable", c) for i, c in enumerate(["missing_tool_name"] * 2 + ["unknown_tool"] + ["malformed_arguments"] * 4)}


def test_a_repair_looks_at_an_argument_once(spark):
    """Every schema of a tool sees the same parsed arguments and kinds; only a value written otherwise is looked at again."""
    tool = {"visit": [{"properties": {"url": {"type": "array"}, "goal": {"type": "string"}}, "required": ["url"]}, {"properties": {"url": {"type": "string"}, "deep": {"type": "boolean"}}}]}
    repaired = spark.range(1).select(schema.repaired("visit", F.from_json(F.lit("{}"), "map<string,variant>"), tool["visit"]).alias("r"))
    plan = repaired._jdf.queryExecution().analyzed().toString()
    # one for all arguments as they are, one for each of the four properties as it would be written
    assert (plan.count("schema_of_variant("), plan.count("from_json(")) == (5, 1)
