"""Evidence, policy and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import arrays, evidence
from tracewright.functions.hashing import seeded_hex
from tracewright.functions.text import compress, normalise
from tracewright.operators.select import best_per_key, global_rank
from tracewright.plans.registry import load, query

STEMS = r"""list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'),
  lambda t: NOT regexp_matches(t, '^[0-9a-f]{{12,}}$') AND t NOT IN ('the','a','an','is','are','at','in','of','to','ve','vf','rf')),
  lambda t: CASE WHEN ends_with(t, 'ies') AND length(t) > 6 THEN left(t, -3) || 'y' WHEN ends_with(t, 'ing') AND length(t) > 6 THEN left(t, -3) WHEN ends_with(t, 'ed') AND length(t) > 5 THEN left(t, -2)
                 WHEN ends_with(t, 'es') AND length(t) > 5 THEN left(t, -2) WHEN ends_with(t, 's') AND length(t) > 4 THEN left(t, -1) ELSE t END)))"""


def answered(turns):
    """(conv_id, turn, text, answer) of each user turn and the assistant turn right after it; turns are ranked over the whole table."""
    placed = global_rank(turns.select(F.struct("conv_id", "turn", "role", "text").alias("at")), "at").select("at.*", "rank")
    answers = placed.where("role = 'assistant'").select("conv_id", F.col("text").alias("answer"), (F.col("rank") - 1).alias("rank"))
    return placed.where("role = 'user'").join(answers, ["conv_id", "rank"]).select("conv_id", "turn", "text", "answer")


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, min(text) AS context FROM conversations WHERE role = 'system' GROUP BY 1),
p AS (SELECT conv_id, turn, (length(text) > 100) = (length(answer) > 100) AS same, {STEMS.format("answer")} AS a, {STEMS.format("answer || ' ' || coalesce(context, '')")} AS c, {STEMS.format("text")} AS g
      FROM t LEFT JOIN s USING (conv_id) WHERE role = 'user' AND who = 'assistant'),
f AS (SELECT conv_id, turn, same, 0 AS side, a AS l, g AS r, len(a) + len(g) AS total, least(len(a), len(g)) AS fewest FROM p UNION ALL SELECT conv_id, turn, same, 1, c, g, len(c) + len(g), least(len(c), len(g)) FROM p),
m AS (
  SELECT *, 1 AS i, 0 AS n FROM f
  UNION ALL
  SELECT conv_id, turn, same, side, l, CASE WHEN hit IS NULL THEN r ELSE list_filter(r, lambda x: x <> hit) END, total, fewest, i + 1, n + CASE WHEN hit IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(r, lambda x: x = l[i] OR (least(length(x), length(l[i])) >= 6 AND abs(length(x) - length(l[i])) <= 2 AND (starts_with(x, l[i]) OR starts_with(l[i], x))))[1] AS hit FROM m WHERE i <= len(l))),
e AS (SELECT conv_id, turn, same, CASE WHEN fewest = 0 THEN 0.0 ELSE 2.0 * n / total END AS f1 FROM m WHERE i = len(l) + 1)
SELECT conv_id, turn, round(CASE WHEN same THEN least(1.0, max(f1) + 0.1) ELSE max(f1) END, 6) AS similarity FROM e GROUP BY conv_id, turn, same""")
def fact_similarities(spark, sf_dir):
    """Token F1 with prefix equivalence, source context and kind bonus, of every user turn and the answer right after it."""
    turns = load(spark, sf_dir, "conversations")
    context = turns.where("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("context"))
    pairs = answered(turns).join(context, "conv_id", "left")
    same = (F.char_length("text") > 100) == (F.char_length("answer") > 100)
    return pairs.select("conv_id", "turn", F.round(evidence.fact_similarity(F.col("answer"), F.col("text"), same, F.col("context")), 6).alias("similarity"))


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS a, lower(regexp_replace(regexp_replace(coalesce(answer, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS b
      FROM t WHERE role = 'user' AND who = 'assistant'),
f AS (SELECT *, {STEMS.format("a")} AS l, {STEMS.format("b")} AS g FROM p WHERE length(a) % 3 = length(b) % 3),
m AS (
  SELECT conv_id, turn, l, g AS r, 1 AS i, 0 AS n FROM f
  UNION ALL
  SELECT conv_id, turn, l, CASE WHEN hit IS NULL THEN r ELSE list_filter(r, lambda x: x <> hit) END, i + 1, n + CASE WHEN hit IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(r, lambda x: x = l[i] OR (least(length(x), length(l[i])) >= 6 AND abs(length(x) - length(l[i])) <= 2 AND (starts_with(x, l[i]) OR starts_with(l[i], x))))[1] AS hit FROM m WHERE i <= len(l))),
s AS (SELECT f.*, CASE WHEN len(f.l) = 0 OR len(g) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / (len(f.l) + len(g)) END AS f1, CASE WHEN len(g) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(f.l, g))::DOUBLE / len(g) END AS recall
      FROM f JOIN m ON f.conv_id = m.conv_id AND f.turn = m.turn AND m.i = len(m.l) + 1),
d AS (SELECT *, CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR f1 >= 0.72 OR recall >= 0.85) THEN 'same_source_text_equivalent' WHEN length(a) % 5 = 0 THEN 'same_source_same_capture'
  WHEN length(a) % 2 = length(b) % 2 AND f1 >= 0.45 THEN 'same_url_semantic_span' END AS method FROM s)
SELECT conv_id, turn, method, round(CASE method WHEN 'same_source_text_equivalent' THEN greatest(0.72, f1, recall) WHEN 'same_source_same_capture' THEN CASE WHEN length(a) % 10 = 0 THEN 0.9 ELSE 0.6 END ELSE f1 END, 6)::DOUBLE AS confidence
FROM d WHERE method IS NOT NULL""")
def relaxed_evidence_matches(spark, sf_dir):
    """User turns as evidence and the answers after them as references; families, pages and kinds come from the texts' lengths."""
    pairs = answered(load(spark, sf_dir, "conversations")).withColumns({"text": normalise(F.col("text")), "answer": normalise(F.col("answer"))})
    size, other = F.char_length("text"), F.char_length("answer")
    url = lambda n: F.concat(F.lit("https://www.example.org/page/"), F.pmod(n, F.lit(2)).cast("string"))
    source = lambda n: F.concat(F.lit("domain:f"), F.pmod(n, F.lit(3)).cast("string"), F.lit(".example.org"))
    item = F.struct(
        url(size).alias("url"), F.lit("support").alias("stance"), source(size).alias("family"), F.col("text").alias("text"), F.when(size % 5 == 0, "reference_comparison").otherwise("page").alias("kind"),
        F.lit("same_capture").alias("binding"), F.lit(None).cast("boolean").alias("same_capture"), F.lit(False).alias("other_capture"), F.when(size % 10 == 0, 0.0).otherwise(0.6).alias("confidence"),
    )
    reference = F.struct(url(other).alias("url"), F.lit("support").alias("stance"), source(other).alias("family"), F.col("answer").alias("text"))
    found = pairs.select("conv_id", "turn", evidence.relaxed_match(item, reference).alias("m")).where("m is not null")
    return found.select("conv_id", "turn", "m.method", F.round("m.confidence", 6).alias("confidence"))


@query(r"""
WITH e AS (SELECT doc_id, sha256(text) AS digest, lang, n_chars % 3 AS stance, regexp_replace(regexp_replace(left(text, 60), '\s+', ' ', 'g'), '^ | $', '', 'g') AS span FROM documents)
SELECT a.doc_id, EXISTS (SELECT 1 FROM e b WHERE a.digest = b.digest AND a.lang = b.lang AND a.stance = b.stance AND b.doc_id <> a.doc_id
  AND a.span <> '' AND left(b.span, 24) <> '' AND (contains(a.span, left(b.span, 24)) OR contains(left(b.span, 24), a.span))) AS matched FROM e a""")
def evidence_reference_matches(spark, sf_dir):
    """Whether another document's reference (the head of its text) matches by URL, text either way, stance, digest and family."""
    span = compress(F.substring("text", 1, 60))
    url = F.concat(F.lit("HTTPS://"), F.col("lang"), F.lit(".Example.org/a/?utm_source="), F.col("doc_id").cast("string"))
    key = evidence.reference_key(url, F.pmod("n_chars", F.lit(3)).cast("string"), F.sha2(F.col("text").cast("binary"), 256), F.concat(F.lit("domain:"), F.col("lang")))
    rows = load(spark, sf_dir, "documents").select("doc_id", key.alias("key"), span.alias("span"))
    # equal references of a key are one row with the least and the greatest document that has it, so a key's group stays small
    held = rows.groupBy(F.col("key").alias("k"), F.substring("span", 1, 24).alias("head")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    on = (F.col("key") == F.col("k")) & ((F.col("lo") != F.col("doc_id")) | (F.col("hi") != F.col("doc_id"))) & evidence.holds_either_way(F.col("span"), F.col("head"))
    found = rows.join(held, on, "left_semi").select("doc_id", F.lit(True).alias("matched"))
    return rows.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(r"""
WITH q AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[-_]+', ' ', 'g')) || CASE WHEN n_chars % 7 = 0 THEN ' fact-checking'  WHEN n_chars % 7 = 1 THEN ' photo_authenticity' ELSE '' END AS t FROM documents),
n AS (SELECT doc_id, lower(regexp_replace(t, '[-_]+', ' ', 'g')) AS t FROM q),
v AS (SELECT doc_id, regexp_matches(t, '\bfact\s*check(er|ing|ed)?\b') OR regexp_matches(t, '\b(fake|false|misleading|debunk(ed|ing)?|hoax)\s+(news|claim|report|image|photo|video|story)\b')
  OR regexp_matches(t, '\b(claim|report|image|photo|video|story)\s+(fake|false|misleading|debunked|hoax)\b') AS verdict, t FROM n)
SELECT doc_id, verdict, verdict OR regexp_matches(t, '\b(ai\s+generated|generated\s+by\s+ai|computer\s+generated|digitally\s+generated|generative\s+ai)\b')
  OR regexp_matches(t, '\b(midjourney|dall\s*e|stable\s+diffusion|image\s+generator|generation\s+source|creation\s+method)\b')
  OR regexp_matches(t, '\b(real\s+or\s+fake|fake\s+or\s+real|(image|photo|photograph)\s+authenticity|authenticity\s+of\s+(the\s+)?image|(image|photo)\s+generation|image\s+manipulation|digitally\s+manipulated)\b') AS origin FROM v""")
def verdict_queries(spark, sf_dir):
    """Texts that look for a ready-made verdict or a picture's making; every seventh length carries a marker of either kind."""
    tail = F.when(F.pmod("n_chars", F.lit(7)) == 0, " fact-checking").when(F.pmod("n_chars", F.lit(7)) == 1, " photo_authenticity").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), tail)
    return load(spark, sf_dir, "documents").select("doc_id", evidence.targets_ready_verdict(text).alias("verdict"), evidence.targets_ready_verdict(text, True).alias("origin"))


@query("""
SELECT event_id, NOT (event_type IN ('click', 'purchase')) OR (CASE WHEN value <= 10 THEN 'before_or_at_cutoff' ELSE 'after_cutoff' END) = 'before_or_at_cutoff' AS eligible FROM events""")
def temporal_eligibility(spark, sf_dir):
    """A goal with a cutoff (clicks and purchases) takes only records aligned before it or at it."""
    goal = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit(evidence.AS_OF_MARKER), F.col("ts").cast("string"))).otherwise("browse")
    alignment = F.when(F.col("value") <= 10, " Before_or_at_cutoff").otherwise("after_cutoff")
    return load(spark, sf_dir, "events").select("event_id", evidence.temporally_eligible(alignment, goal).alias("eligible"))


@query("""
SELECT event_id, coalesce(nullif(json_extract_string(props, '$.tool'), ''), event_type) IN ('click', 'error') AND CAST(json_extract_string(props, '$.k') AS INT) IN (1, 2, 3, 5, 8) AS kept FROM events""")
def archive_filter(spark, sf_dir):
    """Filters with a nested fallback and lists of wanted values."""
    nested = lambda name: F.nullif(F.get_json_object("props", f"$.{name}"), F.lit(""))
    kept = evidence.matches_any([nested("tool"), F.col("event_type")], ["Click", "ERROR"]) & evidence.matches_any([nested("k")], ["1", "2", "3", "5", "8"]) & evidence.matches_any([F.col("props")], [])
    return load(spark, sf_dir, "events").select("event_id", kept.alias("kept"))


@query("""
SELECT event_id, event_type IN ('click', 'error') AND CASE WHEN event_id % 3 = 0 THEN CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INT) IN (0, 1) OR user_id % 2 = 0 WHEN event_id % 3 = 1 THEN user_id % 4 < 2 ELSE event_id % 5 = 0 END AS kept FROM events""")
def archive_items(spark, sf_dir):
    """Events as archive items, whose stage is a list, in the metadata or nowhere, and whose task is an argument of the call."""
    k, even = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")), F.pmod("user_id", F.lit(2)).cast("string")
    stage = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit(', "stage": ["S'), k, F.lit('", "even'), even, F.lit('"], "tool_args": {"task_id": "T"}')))
    stage = stage.when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit(', "stage": null, "metadata": {"stage": "s'), F.pmod("user_id", F.lit(4)).cast("string"), F.lit('"}, "tool_args": {"__question_id": "t"}')))
    stage = stage.otherwise(F.concat(F.lit(', "tool_args": {"task_id": ["x", "'), F.when(F.pmod("event_id", F.lit(5)) == 0, "T").otherwise("y"), F.lit('"], "stage": "S1"}')))
    item = F.parse_json(F.concat(F.lit('{"tool_name": "'), F.col("event_type"), F.lit('"'), stage, F.lit("}")))
    kept = evidence.archive_matches(item, {"tools": ["Click", "ERROR"], "stage": ["s0", "S1", "EVEN0"], "task_id": "t", "nothing": []})
    return load(spark, sf_dir, "events").select("event_id", kept.alias("kept"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN true WHEN 'F' THEN coalesce(CASE WHEN o_totalprice < 50000 THEN false WHEN o_totalprice > 300000 THEN true END,
  substr(o_orderpriority, 1, 1) IN ('1', '2') OR (substr(o_orderpriority, 1, 1) = '3' AND o_custkey % 5 IN (2, 3)), false) ELSE false END AS retry FROM orders""")
def retry_predicate(spark, sf_dir):
    """By status, an explicit verdict, the kind of error and its code."""
    status = F.when(F.col("o_orderstatus") == "P", "in_progress").when(F.col("o_orderstatus") == "F", "pending_error").otherwise("pass")
    verdict = F.when(F.col("o_totalprice") < 50000, False).when(F.col("o_totalprice") > 300000, True)
    error, code = F.substring("o_orderpriority", 1, 1), F.pmod("o_custkey", F.lit(5))
    return load(spark, sf_dir, "orders").select("o_orderkey", evidence.retryable(status, verdict, error, code, ["1", "2"], "3", [2, 3]).alias("retry"))


@query("""
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT vec_id, least(e[1], e[3]) AS ax, least(e[2], e[4]) AS ay, greatest(e[1], e[3]) AS bx, greatest(e[2], e[4]) AS by_, least(e[5], e[7]) AS cx, least(e[6], e[8]) AS cy, greatest(e[5], e[7]) AS dx, greatest(e[6], e[8]) AS dy FROM b),
s AS (SELECT vec_id, greatest(0, least(bx, dx) - greatest(ax, cx)) * greatest(0, least(by_, dy) - greatest(ay, cy)) AS i, (bx - ax) * (by_ - ay) + (dx - cx) * (dy - cy) AS t FROM k)
SELECT vec_id, round(CASE WHEN t - i > 0 THEN i / (t - i) ELSE 0 END, 6) AS iou FROM s""")
def box_overlaps(spark, sf_dir):
    """Intersection over union of two boxes made of each vector's first eight components."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    box = lambda at: F.array(F.least(e[at], e[at + 2]), F.least(e[at + 1], e[at + 3]), F.greatest(e[at], e[at + 2]), F.greatest(e[at + 1], e[at + 3]))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(evidence.box_overlap(box(0), box(4)), 6).alias("iou"))


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS id, unnest(embedding)::DOUBLE AS v FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) AS r, max(v) OVER (PARTITION BY vec_id) AS top FROM e),
z AS (SELECT vec_id, any_value(top) + ln(sum(exp(v - top))) AS spread FROM k GROUP BY 1),
t AS (SELECT vec_id, exp(v - top) AS w, v FROM k WHERE r <= 4)
SELECT vec_id, round(any_value(spread) - sum(w * v) / sum(w), 6) AS loss, true AS valid FROM t JOIN z USING (vec_id) GROUP BY 1""")
def sparse_losses(spark, sf_dir):
    """Cross-entropy of each vector as logits against its own renormalised top four, which are valid probabilities."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", logits.alias("x"), arrays.renormalised(arrays.top_k(F.col("embedding"), 4)).alias("p"))
    return rows.select("vec_id", F.round(evidence.sparse_cross_entropy(F.col("x"), F.col("p")), 6).alias("loss"), evidence.valid_probabilities(F.col("p"), 4).alias("valid"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber * 3600.0 + l_quantity::INT * 60.0 + l_suppkey % 60 + 0.5 END AS seconds FROM lineitem""")
def durations(spark, sf_dir):
    """Texts like 2h 30m 5.5s as seconds; a text without an amount has none."""
    told = F.concat(F.col("l_linenumber").cast("string"), F.lit("h "), F.col("l_quantity").cast("int").cast("string"), F.lit(" m and "), F.pmod("l_suppkey", F.lit(60)).cast("string"), F.lit(".5s"))
    text = F.when(F.col("l_linenumber") == 7, "not known").otherwise(told)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evidence.elapsed_seconds(text).alias("seconds"))


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, list(l_partkey ORDER BY first, l_partkey) AS merged FROM a GROUP BY 1""")
def ordered_unique_merge(spark, sf_dir):
    """U8: what several lists of a case name, each once, in the order of its first mention."""
    firsts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))
    lists = firsts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("first", "l_partkey"))).alias("m"))
    return lists.select("l_orderkey", F.transform("m", lambda x: x["l_partkey"]).alias("merged"))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, event_type, event_id, value, ts > now - INTERVAL 3 DAY AS fresh FROM events, n WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def cache_lookup(spark, sf_dir):
    """The newest result that did not fail for each request key, and whether its time to live still runs."""
    events = load(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = events.agg(F.max("at").alias("now"))
    last = best_per_key(events.where("event_type <> 'error'"), ["user_id", "event_type"], [-F.unix_micros("at"), -F.col("event_id")])
    return last.crossJoin(F.broadcast(now)).select("user_id", "event_type", "event_id", "value", (F.col("at") > F.col("now") - F.expr("interval 3 days")).alias("fresh"))


@query("""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer), k AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT place, c_custkey, n, (SELECT count(*) FROM k WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS subset FROM c JOIN k ON o_custkey = c_custkey""")
def cases_with_candidates(spark, sf_dir):
    """Candidates (customers with orders) joined to the cases with their place from 1, and whether they are a subset of the cases."""
    cases = global_rank(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    candidates = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    strays = candidates.join(cases.select("c_custkey"), "c_custkey", "left_anti").agg((F.count("*") == 0).alias("subset"))
    return cases.join(candidates, "c_custkey").crossJoin(F.broadcast(strays)).select((F.col("rank") + 1).alias("place"), "c_custkey", "n", "subset")


@query("""
WITH d AS (SELECT o_custkey, bool_or(o_orderpriority LIKE '1%') AS early, bool_or(o_orderstatus = 'F') AS fin, bool_and(o_orderstatus = 'O') AS rejected, count(*) AS k FROM orders GROUP BY 1)
SELECT CASE WHEN early AND fin THEN 'winner' WHEN fin THEN 'final_only' WHEN rejected AND k >= 10 THEN 'hard' ELSE 'incomplete' END AS outcome, count(*) AS cases, sum(k)::BIGINT AS attempts FROM d GROUP BY 1""")
def case_outcomes(spark, sf_dir):
    """D29, counts only: each case by whether an early or only a final attempt succeeded, all were rejected, or attempts are still missing."""
    flags = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderpriority").startswith("1")).alias("early"), F.bool_or(F.col("o_orderstatus") == "F").alias("final"), F.bool_and(F.col("o_orderstatus") == "O").alias("rejected"), F.count("*").alias("k")
    )
    outcome = F.when(F.col("early") & F.col("final"), "winner").when(F.col("final"), "final_only").when(F.col("rejected") & (F.col("k") >= 10), "hard").otherwise("incomplete")
    return flags.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("cases"), F.sum("k").alias("attempts"))


@query("""
WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS selected, count(*) FILTER (WHERE quality = 0) AS hard, count(*) FILTER (WHERE quality IS NULL) AS open FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, selected + hard + open = n AS accounted, selected > 0 AS has_selected, CASE WHEN hard > selected THEN 'more_hard_than_selected' WHEN open > selected + hard THEN 'mostly_open' ELSE 'ok' END AS finding FROM s""")
def delivery_accounting(spark, sf_dir):
    """D27 in part: that a delivery's parts add up to its whole, and the first finding of each source."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    parts = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("s"), F.count_if(F.col("quality") == 0).alias("h"), F.count_if(F.col("quality").isNull()).alias("o"))
    finding = F.when(F.col("h") > F.col("s"), "more_hard_than_selected").when(F.col("o") > F.col("s") + F.col("h"), "mostly_open").otherwise("ok")
    return parts.select("source", (F.col("s") + F.col("h") + F.col("o") == F.col("n")).alias("accounted"), (F.col("s") > 0).alias("has_selected"), finding.alias("finding"))


@query("""
WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('quota:' || c_custkey), c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
s AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS strata FROM (SELECT DISTINCT c_nationkey FROM customer))
SELECT c_nationkey, c_custkey, n < 60 // strata + (i < 60 % strata)::INT AS undersupplied FROM r JOIN s USING (c_nationkey) WHERE k <= 60 // strata + (i < 60 % strata)::INT""")
def equal_quota_with_remainder(spark, sf_dir):
    """60 rows in equal quotas by stratum, the remainder to the first strata, in hash order; strata that fall short are named."""
    customer = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    sizes = global_rank(customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey")
    strata = sizes.agg(F.count("*").alias("strata"))
    quota = F.floor(F.lit(60) / F.col("strata")) + F.when(F.col("rank") < F.pmod(F.lit(60), F.col("strata")), 1).otherwise(0)
    quotas = sizes.crossJoin(F.broadcast(strata)).select("c_nationkey", "n", quota.alias("quota"))
    # the k first of a stratum by hash: rows are ranked over the whole table in the order (stratum, hash)
    order = F.struct("c_nationkey", seeded_hex("quota", "c_custkey").alias("h"), "c_custkey")
    ranked = global_rank(customer.select(order.alias("at")), "at").select("at.c_nationkey", "at.c_custkey", "rank")
    first = ranked.groupBy("c_nationkey").agg(F.min("rank").alias("first"))
    kept = ranked.join(first, "c_nationkey").join(quotas, "c_nationkey").where(F.col("rank") - F.col("first") < F.col("quota"))
    return kept.select("c_nationkey", "c_custkey", (F.col("n") < F.col("quota")).alias("undersupplied"))
