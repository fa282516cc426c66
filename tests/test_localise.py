"""Failure anchors and hint audits: a case for each rule, and random traces against a loop."""

import random
import re

from tracewright.operators import localise


def anchor(steps, audits):
    steps, audits = sorted(steps), sorted(audits)
    for _, location in audits:
        found = re.search(r"all_steps\[(\d+)\]", location or "")
        hit = next((s for s in steps if found and s[1] == int(found[1])), None)
        if hit:
            return "strict_trace_audit_location", hit[0], hit[1], True
    for s in steps:
        if s[2]:
            return "first_protocol_rejection", s[0], s[1], True
    at = next((s for s in steps if s[3]), steps[-1])
    return "terminal_outcome_or_unlocated_audit_failure", at[0], at[1], False


def test_anchor_is_that_of_the_loop(spark):
    rng = random.Random(8)
    steps = {c: [(p, rng.randrange(6), rng.random() < 0.1, rng.random() < 0.2) for p in range(rng.randrange(1, 9))] for c in range(80)}
    audits = {c: [(n, rng.choice([None, "nowhere", "state.all_steps[2].x", f"x all_steps[{rng.randrange(12)}]", "all_steps[a]"])) for n in range(rng.randrange(0, 3))] for c in range(90)}
    a = spark.createDataFrame([(c, *s) for c, own in steps.items() for s in own], "case long, place int, source_index int, rejected boolean, judgment boolean").repartition(4)
    b = spark.createDataFrame([(c, *x) for c, own in audits.items() for x in own], "case long, number int, location string")
    got = {r.case: tuple(r)[1:] for r in localise.failure_anchors(a, b).collect()}
    assert got == {c: anchor(own, audits[c]) for c, own in steps.items()} and len({g[0] for g in got.values()}) == 3


def test_hints(spark):
    hints = [
        (1, "Look at the old bridge again.", 1), (2, "  ", 2), (3, "x" * 1201, 3), (4, "fine words", 7), (5, "It is FAKE.", 1), (6, "a real-time check is unreal", 1), (7, "see the Ground_Truth", 1),
        (8, "use  Text_Search\nnow", 2), (9, "use text_search now", 3), (10, "the Secret   city", 4), (11, "abc only", 1), (12, None, None), (13, "no private rows", 1),
    ]
    private = [(1, "gold.claim", "old bridge", False), (1, "gold.claim", " OLD  bridge", False), (1, "gold.a", "again", False), (8, "expected_action.name", "text_search", True), (9, "expected_action.name", "text_search", True), (10, "gold.q", "secret city", False), (11, "gold.s", "abc", False), (5, "gold.n", None, False), (99, "x", "nobody", False)]
    a, b = spark.createDataFrame(hints, "id long, hint string, level int"), spark.createDataFrame(private, "id long, path string, value string, tool boolean")
    got = {r.id: (r.passed, r.errors, r.leak_paths) for r in localise.audited_hints(a, b).collect()}
    bad = lambda *errors, paths=(): (not errors, list(errors), list(paths))
    assert got == {
        1: bad("private_value_leak", paths=["gold.a", "gold.claim"]), 2: bad("hint_empty"), 3: bad("hint_too_long"), 4: bad("hint_level_invalid"), 5: bad("binary_verdict_leak"), 6: bad(), 7: bad("internal_term_leak"),
        8: bad("private_value_leak", paths=["expected_action.name"]), 9: bad(), 10: bad("private_value_leak", paths=["gold.q"]), 11: bad(), 12: bad("hint_empty", "hint_level_invalid"), 13: bad(),
    }


def test_repairable_failures(spark):
    error = "RuntimeError: Chat Completions returned an unusable response: choices=1, finish_reason=stop, content_chars=0, reasoning_chars=17, reasoning_fallback_requested=False"
    traces = [(i, "error", error) for i in range(1, 9)] + [(9, "done", error), (10, "error", error + " more"), (11, "error", None)]
    receipts = [(i, error, "error", "Unified_React") for i in range(1, 7)] + [(7, error, "error", "search"), (8, "other", "error", "unified_react"), (9, error, "error", "unified_judgment"), (10, error, "error", "unified_react")]
    fine = ("complete", [1, 2], [-0.5, -1.0])
    captures = [(i, *fine) for i in (1, 1, 2, 3, 4, 6, 7, 8, 9, 10)] + [(2, "partial", [1], [-1.0]), (3, "complete", [1], [-1.0, -2.0]), (4, "complete", [1], [float("-inf")]), (6, "complete", [], [])]
    frames = [spark.createDataFrame(*x) for x in ((traces, "case long, termination string, error string"), (receipts, "case long, error string, status string, stage string"), (captures, "case long, status string, ids array<long>, logprobs array<double>"))]
    assert [r.case for r in localise.repairable_failures(*frames).collect()] == [1]


def test_archive_filters(spark):
    from pyspark.sql import functions as F

    from tracewright.functions.evidence import archive_matches

    item = '{"tool_name": "Visit", "stage": ["A", "b"], "n": 5, "none": null, "metadata": {"n": 6, "x": true, "none": "m"}, "tool_args": {"__question_id": "Q1", "x": false, "y": [1, null]}}'
    cases = [
        ({"tool": "visit"}, True), ({"tools": ["a", "VISIT"]}, True), ({"tool_name": "other"}, False), ({"stage": "B"}, True), ({"stage": ["c", "d"]}, False), ({"n": 5}, True), ({"n": [6]}, False), ({"none": "M"}, True),
        ({"x": True}, True), ({"x": "false"}, False), ({"y": "1"}, True), ({"y": ["None"]}, True), ({"task_id": "q1"}, True), ({"nowhere": "z"}, False), ({"nowhere": "none"}, True), ({"nowhere": [], "tool": "", "n": None}, True), ({"tool": "visit", "n": 6}, False), ({}, True),
    ]
    row = spark.createDataFrame([(item,)], "t string").select(*(archive_matches(F.parse_json("t"), f).alias(f"c{i}") for i, (f, _) in enumerate(cases))).first()
    assert [row[i] for i in range(len(cases))] == [w for _, w in cases]
