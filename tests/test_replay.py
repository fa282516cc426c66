"""Calls replayed without state against a loop that carries it."""

import random

from pyspark.sql import functions as F

from tracewright.operators import replay

LIMITS = {"search": 3, "visit": 2, "idle": 0}


def run(calls):
    out = {}
    for case in {c[0] for c in calls}:
        taken, counts, finished = set(), {}, False
        for _, place, tool, route, code, masked in sorted(c for c in calls if c[0] == case):
            key = (tool, route or "")
            if code or masked:
                issue = code or "preexisting_mask"
            elif finished:
                issue = "after_finish_investigation"
            elif key in taken:
                issue = "semantic_duplicate"
            elif counts.get(tool, 0) >= LIMITS.get(tool, 10**9):
                issue = "tool_budget_exceeded"
            else:
                issue, finished = "", tool == "finish"
                taken.add(key)
                counts[tool] = counts.get(tool, 0) + 1
            out[case, place] = issue
    return out


def test_replay_is_that_of_the_loop(spark):
    rng = random.Random(6)
    calls = []
    for case, n in [(1, 40), (2, 1), (3, 25), (4, 300), (5, 12), (6, 12), (7, 12)]:
        for k in range(n):
            calls.append((case, 2 * k + 1, rng.choice(["search", "visit", "look", "idle"] + ["finish"] * (rng.random() < 0.3)), rng.choice([None, *"abcdefgh"]), rng.choice([""] * 6 + ["invalid_type"]), rng.choice([False] * 6 + [True])))
    df = spark.createDataFrame(calls, "case long, place long, tool string, route string, code string, masked boolean").repartition(4)
    got = {(r.case, r.place): r.issue for r in replay.replayed(df, LIMITS, "finish").collect()}
    want = run(calls)
    assert got == want and len(set(want.values())) == 6
    roles = {(c, p): rng.choice(["assistant", "user", "tool_response"]) for c, p0, *_ in calls for p in [p0 - 1]}
    messages = spark.createDataFrame([(c, p, "tool_call", not m) for c, p, _, _, _, m in calls] + [(c, p, r, True) for (c, p), r in roles.items()], "case long, place long, role string, had boolean")
    masked = {(c, p): m for c, p, _, _, _, m in calls}
    learned = {k: not masked[k] and not want[k] for k in masked} | {(c, p): not (r == "assistant" and want[c, p + 1] not in ("", "preexisting_mask")) for (c, p), r in roles.items()}
    issues = spark.createDataFrame([(*k, v) for k, v in want.items()], "case long, place long, issue string")
    assert {(r.case, r.place): r.loss for r in replay.learned(messages, issues, loss=F.col("had")).collect()} == learned


def test_nothing_to_replay(spark):
    df = spark.createDataFrame([], "case long, place long, tool string, route string, code string, masked boolean")
    assert replay.replayed(df, {}, "finish").count() == 0
