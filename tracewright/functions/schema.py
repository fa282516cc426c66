"""Calls checked against JSON Schemas and repaired: a schema is compiled once to expressions over VARIANT values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, functions as F

ISSUE = "struct<code:string,path:string>"
CHANGE = "struct<value:variant,change:string>"
SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"

# What a tool accepted in another shape or spelling, by (tool, argument)
OMITTED_EMPTY = {("ocr_with_position", "bbox"): "empty_region_omitted"}
FIRST_BOXES = {("focused_visual_inspection", "anchor_regions"): (4, "runtime_first_four")}
SYNONYMS = {
    ("focused_visual_inspection", "scope"): (("physical_consistency", "physics"), "integrity", "physical_consistency_to_integrity"),
    ("check_consistency", "aspect"): (("physical_consistency",), "physics", "physical_consistency_to_physics"),
}
SINGLE_TO_STRING = {("text_search", "queries"): "singleton_array_to_string"}
STRING_TO_SINGLE = {("visit", "url"): "string_to_singleton_array"}
#: arguments that another one stands in for: (tool, argument) -> what may be missing
STANDS_IN = {("crop_and_inspect", "visual_question_id"): ("bbox", "focus_question")}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it.

    ``element_at`` knows the type of what it returns; ``get`` would derive it anew from all of ``f`` for every row.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def first(columns: list[Column], kind: str) -> Column:
    return F.coalesce(*columns, F.lit(None).cast(kind)) if columns else F.lit(None).cast(kind)


def issue(code: str, path: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(path) if isinstance(path, str) else path).alias("path"))


def kind_of(value: Column) -> Column:
    """The name of a value's type; VOID for a JSON null."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_integer(kind: Column) -> Column:
    """A long, or a number beyond those; 1.0 is none."""
    return (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))


def as_kind(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def value_issue(value: Column, spec: dict, path: str) -> Column:
    """The first issue (code, path) of a value under a schema, null without one; an object's members are looked at in the order of their names."""
    return let(F.struct(value.alias("v"), kind_of(value).alias("kind")), lambda x: issue_of(x["v"], x["kind"], spec, path))


def issue_of(value: Column, kind: Column, spec: dict, path: str) -> Column:
    expected, found = spec.get("type"), []
    whole = lambda key: spec[key] if isinstance(spec.get(key), int) else None
    if expected == "string":
        text = as_kind(value, "string")
        found.append(F.when(kind != "STRING", issue("invalid_type", path)))
        if whole("minLength") is not None:
            found.append(F.when(F.char_length(F.btrim(text, F.lit(SPACE))) < spec["minLength"], issue("invalid_value", path)))
        if whole("maxLength") is not None:
            found.append(F.when(F.char_length(text) > spec["maxLength"], issue("invalid_value", path)))
    if expected == "array":
        found.append(F.when(~F.startswith(kind, F.lit("ARRAY")), issue("invalid_type", path)))
        if any(whole(key) is not None for key in ("minItems", "maxItems")) or isinstance(spec.get("items"), dict):
            found.append(let(as_kind(value, "array<variant>"), lambda items: item_issue(items, spec, path)))
    if expected == "object":
        found.append(F.when(~F.startswith(kind, F.lit("OBJECT")), issue("invalid_type", path)))
        found.append(let(as_kind(value, "map<string,variant>"), lambda members: member_issue(members, spec, path)))
    if expected == "number":
        found.append(F.when(~is_number(kind), issue("invalid_type", path)))
    if expected == "integer":
        found.append(F.when(~is_integer(kind), issue("invalid_type", path)))
    if expected == "boolean":
        found.append(F.when(kind != "BOOLEAN", issue("invalid_type", path)))
    if isinstance(spec.get("enum"), list):
        if all(isinstance(x, str) for x in spec["enum"]):
            allowed = (kind == "STRING") & as_kind(value, "string").isin(spec["enum"])
        else:
            allowed = F.coalesce(F.to_json(value), F.lit("null")).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in spec["enum"]])
        found.append(F.when(~allowed, issue("invalid_enum", path)))
    return first(found, ISSUE)


def item_issue(items: Column, spec: dict, path: str) -> Column:
    found = []
    for key, wrong in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
        if isinstance(spec.get(key), int):
            found.append(F.when(wrong(spec[key]), issue("invalid_value", path)))
    if isinstance(spec.get("items"), dict):
        each = F.transform(items, lambda x: value_issue(x, spec["items"], f"{path}[]"))
        found.append(F.try_element_at(F.filter(each, lambda x: x.isNotNull()), F.lit(1)))
    return first(found, ISSUE)


def member_issue(members: Column, spec: dict, path: str) -> Column:
    properties, names, found = spec.get("properties") or {}, F.map_keys(members), []
    if spec.get("additionalProperties") is False:
        unknown = F.array_sort(F.array_except(names, names_of(spec)))
        found.append(F.when(F.size(unknown) > 0, issue("nested_unknown_argument", F.concat(F.lit(f"{path}."), F.get(unknown, F.lit(0))))))
    found += [F.when(~F.array_contains(names, name), issue("nested_missing_required", f"{path}.{name}")) for name in spec.get("required") or []]
    found += [F.when(F.array_contains(names, name), value_issue(F.element_at(members, F.lit(name)), properties[name], f"{path}.{name}")) for name in sorted(properties) if isinstance(properties[name], dict)]
    return first(found, ISSUE)


def by_name(name: Column, cases: dict[str, Column], kind: str) -> Column:
    """The column of a name, null for one that has none."""
    out = F.lit(None).cast(kind)
    for key, column in cases.items():
        out = F.when(name == key, column).otherwise(out)
    return out


def names_of(schema: dict) -> Column:
    return F.array(*map(F.lit, schema.get("properties") or {})).cast("array<string>")


def entries_of(arguments: Column) -> Column:
    """(name, value, kind) of the arguments in their order; every schema of a tool looks at the same."""
    return F.transform(F.map_entries(arguments), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), kind_of(e["value"]).alias("kind")))


def schema_issues(tool: str, arguments: Column, schema: dict) -> Column:
    """All issues of a call's arguments, a map<string,variant>: unknown names, then required ones, then values in their order."""
    own = lambda given: F.transform(given, lambda x: argument_issue(x["name"], x["value"], x["kind"], schema))
    return let(entries_of(arguments), lambda given: F.concat(issues_unknown(unknown(given, schema)), *missing(tool, given, schema), F.array_compact(own(given))))


def argument_issue(name: Column, value: Column, kind: Column, schema: dict) -> Column:
    checks = {n: spec for n, spec in (schema.get("properties") or {}).items() if isinstance(spec, dict)}
    return by_name(name, {n: issue_of(value, kind, spec, n) for n, spec in checks.items()}, ISSUE)


def unknown(entries: Column, schema: dict) -> Column:
    """The sorted names of entries that the schema does not tell of."""
    return F.sort_array(F.transform(F.filter(entries, lambda x: ~x["name"].isin(*(schema.get("properties") or {}))), lambda x: x["name"]))


def issues_unknown(names: Column) -> Column:
    return F.transform(names, lambda k: issue("unknown_argument", k))


def missing(tool: str, entries: Column, schema: dict) -> list[Column]:
    """The required names that entries of (name, value) do not have, as issues; no column where none is required."""

    def gone(name: str) -> Column:
        out = ~F.exists(entries, lambda x: x["name"] == name)
        for (whose, stand_in), names in STANDS_IN.items():
            if whose == tool and name in names:
                # a JSON null and a false, zero or empty value stand in for nothing
                told = F.try_element_at(F.filter(entries, lambda x: x["name"] == stand_in), F.lit(1))["value"]
                out &= F.btrim(F.coalesce(as_kind(told, "string"), F.lit("")), F.lit(SPACE)).isin("", "0", "0.0", "false")
        return F.when(out, issue("missing_required", name))

    wanted = schema.get("required") or []
    return [F.array_compact(F.array(*map(gone, wanted))).cast(f"array<{ISSUE}>")] if wanted else []


def move_of(tool: str, name: str, value: Column, kind: Column, spec: dict) -> Column | None:
    """(value, change) of an argument written in another shape or spelling of the same meaning, null where it stays; None where there is no other."""
    expected, key = spec.get("type"), (tool, name)
    told = lambda new, change: F.struct(new.alias("value"), F.lit(f"{name}:{change}").alias("change"))
    allowed = [x for x in spec.get("enum") or [] if isinstance(x, str)]
    spelt = [x for x in allowed if sum(x.lower() == y.lower() for y in allowed) == 1]

    def of_list(items: Column) -> list[Column]:
        tries = []
        if key in OMITTED_EMPTY:
            tries.append(F.when(F.size(items) == 0, told(F.lit(None).cast("variant"), OMITTED_EMPTY[key])))
        if key in FIRST_BOXES:
            most, change = FIRST_BOXES[key]
            box = lambda x: F.coalesce((F.size(as_kind(x, "array<variant>")) == 4) & F.forall(as_kind(x, "array<variant>"), lambda y: is_number(kind_of(y))), F.lit(False))
            tries.append(F.when((F.size(items) > most) & F.forall(F.slice(items, 1, most), box), told(F.slice(items, 1, most).cast("variant"), change)))
        if key in SINGLE_TO_STRING and expected == "string":
            tries.append(F.when((F.size(items) == 1) & (kind_of(F.get(items, F.lit(0))) == "STRING"), told(F.get(items, F.lit(0)), SINGLE_TO_STRING[key])))
        return tries

    def of_text(text: Column) -> list[Column]:
        tries = []
        if key in SYNONYMS:
            names, new, change = SYNONYMS[key]
            tries.append(F.when(F.lower(text).isin(*names), told(F.lit(new).cast("variant"), change)))
        if key in STRING_TO_SINGLE and expected == "array":
            tries.append(told(F.array(value).cast("variant"), STRING_TO_SINGLE[key]))
        return tries + [F.when((F.lower(text) == x.lower()) & (text != x), told(F.lit(x).cast("variant"), "enum_case_normalized")) for x in spelt]

    out = []
    if key in OMITTED_EMPTY:
        out.append((kind == "VOID", told(F.lit(None).cast("variant"), OMITTED_EMPTY[key])))
    if key in OMITTED_EMPTY or key in FIRST_BOXES or (key in SINGLE_TO_STRING and expected == "string"):
        out.append((F.startswith(kind, F.lit("ARRAY")), let(as_kind(value, "array<variant>"), lambda items: first(of_list(items), CHANGE))))
    if key in SYNONYMS or (key in STRING_TO_SINGLE and expected == "array") or spelt:
        out.append((kind == "STRING", let(as_kind(value, "string"), lambda text: first(of_text(text), CHANGE))))
    return first([F.when(fits, move) for fits, move in out], CHANGE) if out else None


def variants_of(schemas: list[dict]) -> Iterator[dict]:
    """Different schemas, each once, in order."""
    seen = set()
    for schema in schemas:
        mark = json.dumps(schema, sort_keys=True)
        if mark not in seen:
            seen.add(mark)
            yield schema


RESULT = "struct<status:string,arguments:map<string,variant>,removed:array<string>,changes:array<string>,code:string,fields:array<string>>"


def repaired(tool: str, arguments: Column, schemas: list[dict]) -> Column:
    """The cheapest meaning-preserving repair of a call under several schemas of its tool.

    (status, arguments, removed, changes, code, fields): exact; else, of the schemas under which the arguments hold once unknown ones
    are removed and other spellings normalised, the one with the fewest of both, then the fewest removed, then the least names; else
    unrepairable with the code and fields of the schema with the fewest issues left.
    """
    tries = lambda given: F.array(*(mended(tool, given, s) for s in variants_of(schemas)))
    # what is used twice is worked out once
    return let(arguments, lambda given: let(let(entries_of(given), tries), lambda x: best_of(given, x)))


def mended(tool: str, entries: Column, schema: dict) -> Column:
    """(cost, new, left, issues): a call under one schema, as it is and once unknown arguments are gone and others normalised.

    Each argument is looked at once as it is, and once more only if it is written otherwise: what an unknown one or one that stays has
    to say is the same before and after.
    """
    properties = {k: v for k, v in (schema.get("properties") or {}).items() if isinstance(v, dict)}

    def tried(x: Column) -> Column:
        moves = {n: m for n, s in properties.items() if (m := move_of(tool, n, x["value"], x["kind"], s)) is not None}
        own = argument_issue(x["name"], x["value"], x["kind"], schema)
        return F.struct(x["name"].alias("name"), x["value"].alias("value"), own.alias("issue"), by_name(x["name"], moves, CHANGE).alias("move"))

    def after(x: Column) -> Column:
        new = {n: value_issue(x["move"]["value"], s, n) for n, s in properties.items()}
        entry = lambda value, found: F.struct(x["name"].alias("name"), value.alias("value"), found.alias("issue"))
        return F.when(x["move"].isNull(), entry(x["value"], x["issue"])).otherwise(entry(x["move"]["value"], by_name(x["name"], new, ISSUE)))

    def changed(each: Column) -> Column:
        stay = F.filter(each, lambda x: x["name"].isin(*(schema.get("properties") or {})) & (x["move"].isNull() | x["move"]["value"].isNotNull()))
        changes = F.array_compact(F.transform(each, lambda x: x["move"]["change"]))
        issues = F.concat(*missing(tool, each, schema), F.array_compact(F.transform(each, lambda x: x["issue"])))
        return F.struct(unknown(each, schema).alias("removed"), changes.alias("changes"), F.transform(stay, after).alias("new"), issues.alias("issues"))

    def judged(x: Column) -> Column:
        cost = F.struct((F.size(x["removed"]) + F.size(x["changes"])).alias("n"), F.size(x["removed"]).alias("r"), x["removed"].alias("names"), x["changes"].alias("changed"))
        left = F.concat(*missing(tool, x["new"], schema), F.array_compact(F.transform(x["new"], lambda y: y["issue"])))
        return F.struct(cost.alias("cost"), x["new"].alias("new"), left.alias("left"), F.concat(issues_unknown(x["removed"]), x["issues"]).alias("issues"))

    return let(let(F.transform(entries, tried), changed), judged)


def best_of(arguments: Column, tries: Column) -> Column:
    none = F.array().cast("array<string>")
    result = lambda *parts: F.struct(*(c.alias(n) for n, c in zip(("status", "arguments", "removed", "changes", "code", "fields"), parts)))

    def held(best: Column) -> Column:
        names, changed = best["cost"]["names"], best["cost"]["changed"]
        status = F.when((F.size(names) > 0) & (F.size(changed) > 0), "safe_projection").when(F.size(names) > 0, "unknown_arguments_removed").otherwise("safe_value_normalized")
        new = F.map_from_entries(F.transform(F.get(tries, best["at"])["new"], lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value"))))
        return F.when(best.isNotNull(), result(status, new, names, changed, F.lit(""), none)).otherwise(let(least, failed))

    def failed(rest: Column) -> Column:
        return result(F.lit("unrepairable"), arguments, none, none, F.coalesce(F.get(rest["all"], F.lit(0))["code"], F.lit("schema_mismatch")), F.transform(rest["all"], lambda x: x["path"]))

    some = lambda x: F.when(F.size(x["left"]) > 0, x["left"]).otherwise(x["issues"])
    least = F.array_min(F.transform(tries, lambda x: let(some(x), lambda all: F.struct(F.size(all).alias("n"), all.alias("all")))))
    costs = F.transform(tries, lambda x, i: F.when((F.size(x["left"]) == 0) & (x["cost"]["n"] > 0), F.struct(x["cost"].alias("cost"), i.alias("at"))))
    fine = result(F.lit("exact"), arguments, none, none, F.lit(""), none)
    return F.when(F.exists(tries, lambda x: F.size(x["issues"]) == 0), fine).otherwise(let(F.array_min(costs), held))


def project_call(name: Column, arguments: Column, tools: dict[str, list[dict]]) -> Column:
    """``repaired`` of a call given as a tool's name and its arguments in JSON, by the schemas of each tool.

    Calls without a name, of unknown tools, or whose arguments are no JSON object (names told twice included) are unrepairable.
    """
    none = F.array().cast("array<string>")
    parsed = F.try_parse_json(arguments)
    # what parses and begins with a brace is an object
    braced = F.startswith(F.ltrim(arguments, F.lit(" \t\n\r")), F.lit("{"))
    given = F.when(parsed.isNotNull() & braced, F.from_json(arguments, "map<string,variant>"))
    failed = lambda code, given: F.struct(F.lit("unrepairable").alias("status"), given.alias("arguments"), none.alias("removed"), none.alias("changes"), F.lit(code).alias("code"), none.alias("fields"))
    called = F.btrim(F.coalesce(name, F.lit("")), F.lit(SPACE))

    def told(given: Column) -> Column:
        out = F.when(given.isNull(), failed("malformed_arguments", given))
        for tool, schemas in tools.items():
            out = out.when(called == tool, repaired(tool, given, schemas))
        return out.otherwise(failed("unknown_tool", given))

    return F.when(called == "", failed("missing_tool_name", given)).otherwise(let(given, told)).cast(RESULT)
