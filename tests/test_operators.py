import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import arrays, evidence, html, nested, text, urls
from tracewright.operators import checks, metrics, passages, select, series


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTP://Example.COM:80/a/?utm_source=x&b=2&a=1#f", "http://example.com/a?a=1&b=2"),
        ("example.com", "https://example.com/"),
        ("ftp://h.org:443/", "https://h.org/"),
        ("https://h.org:8443//x//", "https://h.org:8443//x"),
        ("  ", ""),
    ],
)
def test_canonical(spark, given, want):
    assert one(spark, urls.canonical(F.col("u")), u=given) == want


def test_hosts(spark):
    assert one(spark, urls.registered_domain(F.lit("a.b.co.uk"))) == "b.co.uk"
    assert one(spark, urls.registered_domain(F.lit("10.0.0.1"))) == "10.0.0.1"
    assert one(spark, urls.source_class(F.lit("nasa.gov"))) == "official"
    assert one(spark, urls.risk_flags(F.lit("nasa.gov.evil.net"))) == ["lookalike_official_domain"]
    assert one(spark, urls.redact(F.lit("https://a/b?x=1&X-Amz-Sig=9#q"))) == "https://a/b?x=1&X-Amz-Sig=%5BREDACTED%5D#q"
    assert one(spark, urls.archived(F.lit("https://web.archive.org/web/2020id_/http://a.b/c"))) == "http://a.b/c"


def test_text(spark):
    assert one(spark, text.fact_tokens(F.lit("The parties jumped at 0123456789abcdef"))) == ["jump", "party"]
    assert one(spark, text.jaccard(F.array(), F.array())) == 1.0
    assert one(spark, text.goal_score(F.lit("red fox runs"), F.lit('"red fox" now'))) == pytest.approx(8 * 2 / 3 + 2 * 2 / 3 + 4)


def test_arrays(spark):
    assert one(spark, arrays.causal_targets(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [1, 2]
    assert sum(one(spark, arrays.softmax(F.array(F.lit(1.0), F.lit(1000.0))))) == pytest.approx(1)


def test_verified_join(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    cache = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    got = sorted(tuple(r) for r in checks.verified_join(rows, cache, ["k"], ["v"]).collect())
    assert got == [(1, "resolved", ""), (2, "orphan", "v_mismatch"), (2, "rejected", "v_mismatch"), (3, "missing", "not_cached"), (4, "orphan", "not_wanted")]


def test_expectations(spark):
    rows = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    with pytest.raises(checks.ExpectationError):
        checks.require_unique(rows, ["k"])
    with pytest.raises(checks.ExpectationError):
        checks.checked_join(rows.where("k = 1"), spark.createDataFrame([(2,)], "k int"), ["k"])


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "gold int, pred int, v double")
    assert metrics.describe(empty, "v").first().n == 0
    assert metrics.confusion(empty, "gold", "pred", [0, 1]).agg(F.sum("support")).first()[0] == 0


def test_global_rank(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r["rank"] for r in select.global_rank(rows, "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_global_rank_when_shuffles_are_coalesced(spark, tmp_path):
    """The written ranks of wide rows, with partitions of different sizes in the wide and in the narrow reader."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("200k", "4k", "64")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) * 30_000 + F.col("id")).alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
        select.global_rank(rows, "id").write.parquet(f"{tmp_path}/ranks")
        got = spark.read.parquet(f"{tmp_path}/ranks").orderBy("id").select("rank").toPandas()["rank"].tolist()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == list(range(30_000))


def test_by_list_names_missing_ids(spark):
    with pytest.raises(ValueError):
        select.by_list(spark.range(3), "id", [1, 7]).collect()


def test_moving_average_marks_nan(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, float("nan"), 3.0, 5.0, 7.0])], "k int, i int, v double")
    got = [r.moving_average for r in series.moving_average(rows, ["k"], ["i"], "v", 2).orderBy("i").collect()]
    assert got[0] == 1.0 and got[1] != got[1] and got[2] != got[2] and got[3:] == [4.0, 6.0]


def test_passages_keep_offsets(spark):
    body = "A first one. " * 80 + "\n\nsecond  paragraph\n\n" + "x" * 1500
    spans = one(spark, passages.passages(F.col("t"), 700), t=body)
    assert all(s.end - s.start <= 700 for s in spans) and all(a.end <= b.start for a, b in zip(spans, spans[1:]))
    assert "".join("".join(body[s.start : s.end].split()) for s in spans) == "".join(body.split())


def test_greedy_orders(spark):
    items = F.array(*(F.array(*map(F.lit, x)) for x in (["a", "b"], ["a", "b"], ["c"], ["a", "c"])))
    assert one(spark, passages.accepted(items, 0.9)) == [["a", "b"], ["c"], ["a", "c"]]
    wanted = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (2, 1, ["z"])], "k long, id long, t array<string>")
    found = spark.createDataFrame([(1, 7, ["a", "b"]), (1, 5, ["a"])], "k long, id long, t array<string>")
    got = sorted(tuple(r) for r in passages.greedy_match(wanted, found, "k", 0.4).collect())
    assert got == [(1, 1, 7, 1.0), (1, 2, 5, 0.5), (2, 1, None, None)]


def test_nested(spark):
    body = json.dumps({"b": [{"url": "http://bad/x", "n": 1}, {"url": "http://ok"}], "a": {"Gold": 2}})
    assert [(r.path, r.value) for r in one(spark, nested.walk(F.col("t")), t=body)] == [("$.b[0].url", "http://bad/x"), ("$.b[0].n", "1"), ("$.b[1].url", "http://ok"), ("$.a.Gold", "2")]
    assert one(spark, nested.private_paths(F.col("t"), ["gold"]), t=body) == ["$.a.Gold"]
    assert one(spark, nested.without(F.col("t"), "://bad"), t=body) == '{"a":{"Gold":2},"b":[{"url":"http://ok"}]}'
    assert one(spark, nested.compact(F.col("t"), 1, 3), t='{"a": "long text", "b": [1]}') == '{"a":"lon…","b":"…"}'


def test_html_to_text_resolves_all_entities(spark):
    page = "<html><SCRIPT type='a'>if (a < b) x()</SCRIPT><style>p{}</style><h1>T&eacute;l&#233; &hellip;</h1><p class=x>a &lt; b<br/>c</P ><div>d\r</div>&amp;&notanentity;&nbsp;<!-- gone -->1 < 2"
    assert one(spark, html.to_text(F.col("t")), t=page) == "    Télé …\n\n a < b\nc\n\n d\n\n&¬anentity;\xa0 1 < 2"
    assert one(spark, html.to_text(F.lit(None).cast("string"))) == ""


def test_query_tokens_use_route_stopwords(spark):
    assert one(spark, text.query_tokens(F.lit("When does the runner visit by which cities"))) == sorted({"when", "does", "runner", "visit", "by", "citi"})


def test_token_f1_takes_prefixes_and_each_token_once(spark):
    f1 = lambda a, b: one(spark, evidence.token_f1(F.array_sort(F.array(*map(F.lit, a))), F.array_sort(F.array(*map(F.lit, b)))))
    assert f1(["running", "x"], ["runnings", "y"]) == pytest.approx(0.5)
    assert f1(["report", "reports"], ["reporte"]) == pytest.approx(2 / 3)  # one match only
    assert f1(["short", "a"], ["shorts"]) == 0.0 and f1(["abcdef"], ["abcdefghi"]) == 0.0


def test_fact_similarity_uses_context_and_kind(spark):
    value = one(spark, evidence.fact_similarity(F.lit("crowd"), F.lit("crowd paris"), F.lit(True), F.lit("in Paris")))
    assert value == 1.0
    assert one(spark, evidence.fact_similarity(F.lit("crowd"), F.lit("crowd paris"), F.lit(False), F.lit(None).cast("string"))) == pytest.approx(2 / 3)


def test_evidence_scalars(spark):
    box = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    none = F.lit(None).cast("array<double>")
    assert one(spark, evidence.box_overlap(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, evidence.box_overlap(none, none)) == 1.0 and one(spark, evidence.box_overlap(none, box(0, 0, 1, 1))) == 0.0 and one(spark, evidence.box_overlap(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, evidence.elapsed_seconds(F.lit("1h 2m 3.5s"))) == 3723.5 and one(spark, evidence.elapsed_seconds(F.lit("soon"))) is None
    pair = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("prob")) for i, p in ((0, 0.5), (1, 0.5))))
    assert one(spark, evidence.valid_probabilities(pair, 2)) and not one(spark, evidence.valid_probabilities(pair, 3))
    assert one(spark, evidence.sparse_cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), pair)) == pytest.approx(0.6931471805599453)


def test_evidence_policies(spark):
    assert one(spark, evidence.targets_ready_verdict(F.lit("Fact-Checkers on this"))) is False and one(spark, evidence.targets_ready_verdict(F.lit("a fact_check"))) is True
    assert one(spark, evidence.targets_ready_verdict(F.lit("stable-diffusion"), True)) is True and one(spark, evidence.targets_ready_verdict(F.lit(None).cast("string"))) is False
    goal = F.lit(evidence.AS_OF_MARKER + "2020")
    assert one(spark, evidence.temporally_eligible(F.lit(" BEFORE_or_at_cutoff "), goal)) and not one(spark, evidence.temporally_eligible(F.lit(None).cast("string"), goal))
    assert one(spark, evidence.temporally_eligible(F.lit(None).cast("string"), F.lit("browse")))
    retry = lambda *x: one(spark, evidence.retryable(*x, ["Timeout"], "Http", [429]))
    nil = F.lit(None)
    assert retry(F.lit("in_progress"), nil.cast("boolean"), nil.cast("string"), nil.cast("int")) and retry(F.lit("pending_error"), nil.cast("boolean"), F.lit("Http"), F.lit(429))
    assert not retry(F.lit("pending_error"), F.lit(False), F.lit("Timeout"), F.lit(1)) and not retry(F.lit("pass"), F.lit(True), F.lit("Timeout"), F.lit(1))


def test_percentiles_of_groups_that_span_partitions(spark):
    """Ties, a hot group over many range partitions, a group of nulls, a null group and an empty table against numpy."""
    import random

    import numpy as np

    from tracewright.operators import metrics

    rng = random.Random(5)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(6000)] + [("one", 7.0), ("tie", 2.0), ("tie", 2.0), (None, 1.0), (None, 4.0), ("nothing", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in metrics.describe(table, "v", ["g"]).collect()}
    disc = {r.g: r for r in metrics.nearest_rank(table, "v", ["g"], [0.5, 0.9]).collect()}
    assert set(got) == set(disc) == {"hot", "one", "tie", "nothing", None}
    for g in ("hot", "one", "tie", None):
        held = sorted(v for k, v in rows if k == g)
        assert [got[g][p] for p in ("p50", "p90", "p95")] == [round(float(np.percentile(held, q)), 3) for q in (50, 90, 95)]
        assert [disc[g].p50, disc[g].p90] == [held[-(-len(held) * q // 100) - 1] for q in (50, 90)]
        assert (got[g].n, got[g].max) == (len(held), held[-1])
    assert got["nothing"].n == 0 and got["nothing"].p50 is None and disc["nothing"].p90 is None
    held = sorted(v for _, v in rows if v is not None)
    assert list(metrics.quartile_bounds(table, "v").first()) == [held[len(held) * q // 4] for q in (1, 2, 3)]
    empty = table.where("g = 'absent'")
    assert metrics.describe(empty, "v", ["g"]).count() == 0 and metrics.quartile_bounds(empty, "v").first().q1 is None


def test_asof_join_of_a_hot_key(spark):
    """A key over many range partitions, ties in time, null keys and keys without a right row against a scan."""
    import random

    from tracewright.operators import checks

    rng = random.Random(8)
    left = [(i, k, rng.randrange(500)) for i in range(900) for k in [rng.choice([1, 1, 1, 1, 2, 3, None])]]
    right = [(k, rng.randrange(500), rng.randrange(9)) for _ in range(60) for k in [rng.choice([1, 1, 2, None])]]
    want = {}
    for i, k, t in left:
        seen = [(u, v) for q, u, v in right if q == k and u <= t]
        want[i] = max(seen, default=(None, None))
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, u long, v long")
    got = {r.id: (r.u, r.v) for r in checks.asof_join(a, b, ["k"], "t", "u", ["v"]).collect()}
    assert got == want


def test_greedy_match_against_a_loop(spark):
    """Random sets with ties, empty sets, keys without a partner and a null key."""
    import random

    rng = random.Random(3)
    some = lambda: sorted(rng.sample("abcdefg", rng.randrange(4)))
    wanted = [(k, i, some()) for k in (1, 2, 3) for i in range(12)] + [(None, 1, ["a"])]
    found = [(k, i + 100, some()) for k in (1, 2) for i in range(9)] + [(None, 5, ["a"])]
    want, taken = {}, set()
    for k, i, t in wanted:
        alike = lambda u: 1.0 if not t and not u else len({*t} & {*u}) / max(1, len({*t} | {*u}))  # noqa: E731,B023
        best = min(((-alike(u), f) for q, f, u in found if q == k and k is not None and (q, f) not in taken and alike(u) >= 0.3), default=None)
        taken |= {(k, best[1])} if best else set()
        want[k, i] = (best[1], -best[0]) if best else (None, None)
    schema = "k long, id long, t array<string>"
    out = passages.greedy_match(spark.createDataFrame(wanted, schema), spark.createDataFrame(found, schema), "k", 0.3)
    assert {(r.k, r.wanted): (r.found, r.similarity) for r in out.collect()} == want


def test_greedy_match_streams_the_pairs_of_a_key(spark):
    """No key is one frame; rows of one id with different tokens are compared one by one."""
    wanted = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 1, ["c", "d"]), (1, 2, ["a", "b"]), (1, 3, [""]), (1, 4, [])], "k long, id long, t array<string>")
    found = spark.createDataFrame([(1, 7, ["b", "c"]), (1, 8, ["a", "b", "b"]), (1, 8, ["a", "b"]), (1, 9, [])], "k long, id long, t array<string>")
    out = passages.greedy_match(wanted, found, "k", 0.3)
    assert "FlatMapGroups" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 1, 8, 1.0), (1, 2, 7, 1 / 3), (1, 3, None, None), (1, 4, 9, 1.0)]


def test_similar_sets_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    sets = {i: sorted(rng.sample("abcdefghijklmnopqrst", rng.randrange(9))) for i in range(60)}
    table = spark.createDataFrame(list(sets.items()), "id long, t array<string>")
    for percent in (15, 50, 75, 100):
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
        assert {(r.a, r.b) for r in passages.similar_sets(table, percent).collect()} == want


def test_process_scores_of_single_traces(spark):
    from tracewright.operators import scoring

    steps = [  # trace, place, id, tool, status, no_match, judged
        ("good", 1, "a", "search", "success", True, False), ("good", 2, "b", "search", "success", False, False), ("good", 3, None, None, "success", False, True),
        ("late", 1, "a", "search", "success", False, True), ("late", 2, "b", "current_time", "error", False, False), ("late", 3, None, None, "success", False, False),
        ("swapped", 1, "a", "search", "success", False, False), ("swapped", 2, "b", "search", "success", False, False), ("swapped", 3, "c", "search", "malformed", False, True),
        (None, 1, "a", "search", "success", False, False),
    ]
    traces = [
        ("good", "real", "real", True, ["a", "b"], ["b"]), ("late", "real", "real", True, ["a"], ["a", "a"]), ("swapped", "fake", "fake", True, ["b", "a"], ["c"]),
        ("bare", "real", None, True, None, None),
    ]
    out = scoring.process_scores(
        spark.createDataFrame(traces, "trace string, expected string, verdict string, finished boolean, basis array<string>, cited array<string>"),
        spark.createDataFrame(steps, "trace string, place int, id string, tool string, status string, no_match boolean, judged boolean"), ["current_time"],
    )
    got = {r.trace: (r.actions, r.post_actions, r.low_value_rate, r.total, r.reasons, r.eligible) for r in out.collect()}
    assert got == {
        "good": (2, 0, 0.0, round(3 - 0.5 / 24, 6), [], True),
        "late": (2, 1, 0.5, round(1 - 0.5 / 24, 6), ["verdict_observation_citation_invalid", "actions_after_judgment"], False),
        "swapped": (3, 0, 0.0, round(0 + 0 + 1 - 1 - 0.75 / 24, 6), ["incorrect_result", "engineering_error", "verdict_basis_misaligned", "verdict_observation_citation_invalid"], False),
        "bare": (0, 0, 0.0, 1.0, ["incorrect_result", "engineering_error"], False),
    }


def test_relaxed_match_rules_in_order(spark):
    base = {"url": "https://a.org/x", "stance": "support", "family": "domain:a.org", "text": "", "kind": "page", "binding": "", "same_capture": None, "other_capture": None, "confidence": 0.0}
    near = "workers painted seven bridges, closed roads"
    cases = [
        ({"text": "The  Ferry sank"}, {"text": "the ferry sank off the coast"}, ("same_source_text_equivalent", 0.72)),
        ({"text": "seven bridges were painted"}, {"text": "painting seven bridges"}, ("same_source_text_equivalent", 1.0)),
        ({"text": "alpha beta", "kind": "reference_comparison", "binding": "same_capture"}, {"text": "gamma"}, ("same_source_same_capture", 0.9)),
        ({"text": "alpha beta", "kind": "reference_comparison", "binding": "same_capture", "confidence": 0.4}, {"text": "gamma"}, ("same_source_same_capture", 0.4)),
        ({"text": "alpha beta", "kind": "reference_comparison", "binding": "same_capture", "other_capture": True}, {"text": "gamma"}, None),
        ({"text": "workers painted seven houses"}, {"text": near, "url": "https://A.org/x#top"}, ("same_url_semantic_span", 0.6)),
        ({"text": "workers painted seven houses"}, {"text": near, "url": "https://a.org/y"}, None),
        ({"text": "same words"}, {"text": "same words", "stance": "refute"}, None),
        ({"text": "same words"}, {"text": "same words", "family": "domain:b.org"}, None),
        ({"text": "same words", "family": ""}, {"text": "same words", "family": ""}, None),
        ({"text": None}, {"text": None}, None),
    ]
    pair = "url string, stance string, family string, text string"
    rows = [(i, {**base, **e}, {**{k: base[k] for k in ("url", "stance", "family", "text")}, **r}) for i, (e, r, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, f"i int, e struct<{pair.replace(' string', ':string')}, kind:string, binding:string, same_capture:boolean, other_capture:boolean, confidence:double>, r struct<{pair.replace(' string', ':string')}>")
    got = {r.i: r.m and (r.m.method, round(r.m.confidence, 6)) for r in table.select("i", evidence.relaxed_match(F.col("e"), F.col("r")).alias("m")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
