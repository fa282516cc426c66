"""Reference facts and evidence chains against loops over cases."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import reference

STOP = {"the", "a", "an", "is", "are", "at", "in", "of", "to", "ve", "vf", "rf"}


def stem(t):
    for end, least in (("ies", 6), ("ing", 6), ("ed", 5), ("es", 5), ("s", 4)):
        if t.endswith(end) and len(t) > least:
            return t[: -len(end)] + ("y" if end == "ies" else "")
    return t


def tokens(text):
    return sorted({stem(t) for t in (text or "").lower().split() if t not in STOP})


def f1(a, b):
    if not a or not b:
        return 0.0
    left, n = list(b), 0
    for t in a:
        hit = next((x for x in left if x == t or (min(len(x), len(t)) >= 6 and abs(len(x) - len(t)) <= 2 and (x.startswith(t) or t.startswith(x)))), None)
        if hit:
            left.remove(hit)
            n += 1
    return 2.0 * n / (len(a) + len(b))


def similarity(runtime, gold):
    whole = " ".join(x for x in ((runtime[2] or "").strip(), (runtime[4] or "").strip()) if x)
    best = max(f1(tokens(runtime[2]), tokens(gold[3])), f1(tokens(whole), tokens(gold[3])))
    return min(1.0, best + 0.1) if (runtime[3] or "") == (gold[4] or "") else best


def in_turn(gold, runtime, least):
    out, taken = {}, set()
    for g in sorted(gold, key=lambda g: (g[0], g[2])):
        ranked = sorted((-similarity(r, g), r[1]) for r in runtime if r[0] == g[0] and (r[0], r[1]) not in taken)
        if ranked and -ranked[0][0] >= least:
            taken.add((g[0], ranked[0][1]))
            out[g[0], g[1]] = (ranked[0][1], round(-ranked[0][0], 6))
    return out


GOLD = "case long, gold long, place int, statement string, kind string"
RUNTIME = "case long, fact long, statement string, kind string, context string"


def facts(rng, cases):
    words = ["bridge", "bridges", "bridgexy", "bridging", "river", "the", "flood", "city", "photos", "photo", "citizens", "citizen", "x1", "tower", "towers", "towered", "old", "new"]
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.03 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    gold = [(c, i, i, text(), rng.choice(["a", "b", None])) for c, n in cases for i in range(n)]
    return gold, [(c, i, text(), rng.choice(["a", "b", None]), rng.choice([None, "", text()])) for c, n in cases for i in range(n + 3)]


@pytest.mark.parametrize("least", [0.15, 0.5, 0.8])
def test_facts_are_taken_in_turn(spark, least):
    """Small cases, and one with most of the rows, whose facts want the same ones."""
    gold, runtime = facts(random.Random(5), [(1, 4), (2, 0), (3, 7), (9, 45)])
    got = reference.fact_matches(spark.createDataFrame(gold, GOLD), spark.createDataFrame(runtime, RUNTIME), least).collect()
    assert {(r.case, r.gold): (r.fact, round(r.similarity, 6)) for r in got} == in_turn(gold, runtime, least)


def test_a_match_needs_more_than_the_kind(spark):
    with pytest.raises(ValueError):
        reference.fact_matches(spark.createDataFrame([], GOLD), spark.createDataFrame([], RUNTIME), 0.1)
    assert reference.fact_matches(spark.createDataFrame([], GOLD), spark.createDataFrame([], RUNTIME), 0.5).count() == 0


def test_contexts_of_selected_items(spark):
    items = [
        (1, "e1", 1, "t", "HTTP://A.org/p/", [1, 2, 2], "same_capture", True, None, True),
        (1, "e2", 2, "t", "http://a.org/p", [3], "same_capture", True, False, True),
        (1, "e3", 3, "t", "http://a.org/p", [4], "same_capture", True, True, True),  # likely another capture
        (1, "e4", 4, "t", "http://a.org/p", [4], "page", True, None, True),
        (1, "e5", 5, "t", "http://a.org/p", [4], "same_capture", True, None, False),  # not selected
        (1, "e6", 6, "", "http://a.org/p", [4], "same_capture", True, None, True),
        (1, "e7", 7, "t", None, [4], "same_capture", True, None, True),
    ]
    found = [(1, "t", "http://a.org/p", [2, 3], 2, " late ", "", "words"), (1, "t", "http://a.org/p", [1], 1, "early", None, " "), (1, "t", "http://a.org/p", [3, 1], 3, "early", "", None), (1, "t", "http://a.org/p", [1], 4, "", " ", None), (2, "t", "http://a.org/p", [1], 1, "other case", "", ""), (1, "u", "http://a.org/p", [1], 1, "other task", "", "")]
    a = spark.createDataFrame(items, "case long, evidence string, place int, task string, url string, facts array<int>, binding string, same_capture boolean, other_capture boolean, selected boolean")
    b = spark.createDataFrame(found, "case long, task string, url string, facts array<int>, place int, title string, candidate_url string, snippet string")
    got = {(r.case, r.fact): r.context for r in reference.source_contexts(a, b).collect()}
    assert got == {(1, 1): "early late words", (1, 2): "early late words", (1, 3): "late words early"}


ITEM = "struct<url:string,stance:string,family:string,text:string,kind:string,binding:string,same_capture:boolean,other_capture:boolean,confidence:double,digest:string,qualified:boolean,selected:boolean,risky:boolean,directness:string,quality:string>"


def item(text, binding="page", family="news.org", stance="support", url="http://n.org/a", digest="AB", qualified=True, selected=True, kind="page", risky=False, directness="direct", quality="strong", same=True):
    return (url, stance, family, text, kind, binding, same, False, 0.0, digest, qualified, selected, risky, directness, quality)


def test_chains(spark):
    """A case for each tier, the order of references, complements, the tie to the picture and the rates."""
    gold = spark.createDataFrame([(1, 1, "supported", True), (1, 2, "refuted", True), (1, 3, "supported", False), (2, 1, "supported", False)], "case long, gold long, expected_status string, anchored boolean")
    runtime = spark.createDataFrame([(1, 11, "supported"), (1, 12, "refuted"), (2, 11, "refuted")], "case long, fact long, status string")
    matches = spark.createDataFrame([(1, 1, 11, 0.9), (1, 2, 12, 0.8), (2, 1, 11, 0.7)], "case long, gold long, fact long, similarity double")
    rows = [
        (1, "exact", item("the  old bridge stands", digest="ab")),
        (1, "alike", item("bridge of old stands tall in flood", digest="zz", qualified=True)),
        (1, "unqualified", item("the old bridge stands", digest="zz", qualified=False)),
        (1, "chain", item("nothing of it", binding="same_capture")),
        (1, "unselected", item("nothing of it", binding="same_capture", selected=False)),
        (1, "stranger", item("nothing of it", binding="same_capture", family="blog.org")),
        (1, "against", item("nothing of it", binding="same_capture", stance="refute")),
        (1, "capture", item("no words shared", binding="same_capture", kind="reference_comparison", family="domain:press", stance="refute")),
        (2, "risky", item("unlike", binding="same_capture", risky=True)),
    ]
    rows[0] = (1, "exact", item("the  old bridge stands", digest="ab", binding="source_assertion"))
    evidence = spark.createDataFrame(rows, f"case long, evidence string, item {ITEM}")
    links = [(1, 11, e) for _, e, _ in rows[:7]] + [(1, 12, "capture"), (2, 11, "risky"), (1, 11, "missing")]
    refs = [(1, 1, 0, "r0", item("bridge")[:10] + item("bridge")[10:]), (1, 1, 1, "r1", item("old bridge", url="http://N.org/a/", digest="aB")), (1, 1, 2, "r2", item("old bridge stands", digest="ab")), (1, 2, 0, "r3", item("something else", family="press.net", stance="refute"))]
    refs[0] = (1, 1, 0, "r0", item("old bridge stands tall", url="http://other.org", digest="q"))
    references = spark.createDataFrame(refs, f"case long, gold long, place int, source string, reference {ITEM}")
    told, found = reference.reference_chains(gold, runtime, matches, spark.createDataFrame(links, "case long, fact long, evidence string"), evidence, references)
    assert {(r.case, r.gold, r.evidence): (r.source, r.method, r.confidence) for r in found.collect()} == {
        (1, 1, "exact"): ("r1", "canonical_reference", 1.0),
        (1, 1, "alike"): ("r0", "same_source_text_equivalent", 1.0),
        (1, 1, "chain"): ("", "same_source_chain_complement", 1.0),
        (1, 2, "capture"): ("r3", "same_source_same_capture", 0.9),
    }
    got = {(r.case, r.gold): (r.fact, r.status_match, r.anchor_recovered, r.n_evidence, r.chain_recovered) for r in told.collect()}
    # fact 12 is refuted: only a direct source or capture ties it to the picture
    assert got == {(1, 1): (11, True, True, 3, True), (1, 2): (12, True, True, 1, True), (1, 3): (None, False, False, 0, False), (2, 1): (11, False, True, 0, False)}
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case long")
    selected = spark.createDataFrame([(1, "exact"), (1, "against"), (1, "chain"), (3, "x")], "case long, evidence string")
    rates = {r.case: tuple(r)[1:] for r in reference.chain_metrics(cases, told, found, selected).collect()}
    assert rates == {1: (0.666667, 0.666667, 0.666667, 0.666667), 2: (1.0, 0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0, 0.0), 4: (1.0, 1.0, 1.0, 1.0)}
