"""Reference facts and evidence chains: conversations as cases, their turns as facts, the turns' clauses as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import reference
from tracewright.plans.evidence import STEMS
from tracewright.plans.registry import load, query


@query(r"""
WITH l AS (
  SELECT l_orderkey AS "case", l_linenumber AS place, l_partkey AS evidence, l_suppkey % 40 AS url, l_returnflag AS flag, l_linestatus AS status, l_discount AS discount,
         list_distinct([l_linenumber % 3, l_suppkey % 5, 7]) AS facts, p_name, p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (
  SELECT a."case", a.place AS item, a.evidence, b.place AS found, a.facts, concat_ws(' ', nullif(trim(b.p_name), ''), 'http://x.org/' || b.url, nullif(trim(b.p_type), '')) AS context
  FROM l a JOIN l b ON a."case" = b."case" AND a.url = b.url AND a.flag = b.flag AND list_has_any(a.facts, b.facts)
  WHERE a.status = 'O' AND a.discount < 0.08),
e AS (SELECT "case", fact, context, min((item, evidence, found)) AS met FROM (SELECT * EXCLUDE (facts), unnest(facts) AS fact FROM m) GROUP BY "case", fact, context)
SELECT "case", fact, string_agg(context, ' ' ORDER BY met, context) AS context FROM e GROUP BY ALL""")
def source_contexts(spark, sf_dir):
    """An order's open lines as selected same-capture items, its lines as discoveries; tasks are return flags, urls suppliers."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    facts = F.array(F.pmod("l_linenumber", F.lit(3)).cast("long"), F.pmod("l_suppkey", F.lit(5)).cast("long"), F.lit(7).cast("long"))
    url = F.concat(F.lit("http://x.org/"), F.pmod("l_suppkey", F.lit(40)).cast("string"))
    rows = lines.select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("evidence"), F.col("l_returnflag").alias("task"), url.alias("url"), facts.alias("facts"), "l_linestatus", "l_discount", "p_name", "p_type")
    items = rows.select("case", "evidence", "place", "task", "url", "facts", F.lit("same_capture").alias("binding"), F.lit(True).alias("same_capture"), F.lit(None).cast("boolean").alias("other_capture"), ((F.col("l_linestatus") == "O") & (F.col("l_discount") < 0.08)).alias("selected"))
    return reference.source_contexts(items, rows.select("case", "task", "url", "facts", "place", F.col("p_name").alias("title"), F.col("url").alias("candidate_url"), F.col("p_type").alias("snippet")))


LEAST = 0.15


def conversation_facts(spark, sf_dir):
    """(gold, runtime): user turns as gold facts in order, assistant turns as runtime facts with the system turn as context."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case"), "turn", "role", F.col("text").alias("statement"))
    kind = F.when(F.contains(F.coalesce("statement", F.lit("")), F.lit("\n")), "several").otherwise("one")
    status = F.when(F.pmod(F.char_length("statement"), F.lit(4)) == 0, "refuted").otherwise("supported")
    turns = turns.withColumns({"kind": kind, "status": status})
    context = turns.where("role = 'system'").groupBy("case").agg(F.min("statement").alias("context"))
    gold = turns.where("role = 'user'").select("case", F.col("turn").alias("gold"), F.col("turn").alias("place"), "statement", "kind", F.col("status").alias("expected_status"), (F.col("kind") == "several").alias("anchored"))
    return gold, turns.where("role = 'assistant'").select("case", F.col("turn").alias("fact"), "statement", "kind", "status").join(context, "case", "left")


MATCHED = f"""t AS (SELECT conv_id, turn, role, text, CASE WHEN contains(coalesce(text, ''), chr(10)) THEN 'several' ELSE 'one' END AS kind, CASE WHEN length(text) % 4 = 0 THEN 'refuted' ELSE 'supported' END AS status FROM conversations),
y AS (SELECT conv_id, min(text) AS context FROM conversations WHERE role = 'system' GROUP BY 1),
p AS (SELECT u.conv_id, u.turn AS gold, a.turn AS fact, u.kind = a.kind AS same, {STEMS.format("a.text")} AS x, {STEMS.format("concat_ws(' ', nullif(trim(coalesce(a.text, '')), ''), nullif(trim(coalesce(context, '')), ''))")} AS c, {STEMS.format("u.text")} AS g
      FROM t u JOIN t a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant' LEFT JOIN y ON y.conv_id = u.conv_id),
f AS (SELECT conv_id, gold, fact, same, 0 AS side, x AS l, g AS r, len(x) + len(g) AS total, least(len(x), len(g)) AS fewest FROM p UNION ALL SELECT conv_id, gold, fact, same, 1, c, g, len(c) + len(g), least(len(c), len(g)) FROM p),
m AS (
  SELECT *, 1 AS i, 0 AS n FROM f
  UNION ALL
  SELECT conv_id, gold, fact, same, side, l, CASE WHEN hit IS NULL THEN r ELSE list_filter(r, lambda v: v <> hit) END, total, fewest, i + 1, n + CASE WHEN hit IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(r, lambda v: v = l[i] OR (least(length(v), length(l[i])) >= 6 AND abs(length(v) - length(l[i])) <= 2 AND (starts_with(v, l[i]) OR starts_with(l[i], v))))[1] AS hit FROM m WHERE i <= len(l))),
e AS (SELECT conv_id, gold, fact, same, CASE WHEN fewest = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / total END AS f1 FROM m WHERE i = len(l) + 1),
s AS (SELECT conv_id, gold, fact, CASE WHEN same THEN least(1.0::DOUBLE, max(f1) + 0.1::DOUBLE) ELSE max(f1) END AS s FROM e GROUP BY conv_id, gold, fact, same),
w AS (SELECT u.conv_id, u.turn AS gold, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS k, (SELECT coalesce(list(struct_pack(f := s.fact, s := s.s) ORDER BY s.s DESC, s.fact), []) FROM s WHERE s.conv_id = u.conv_id AND s.gold = u.turn AND s.s >= {LEAST}) AS wishes FROM t u WHERE role = 'user'),
r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS gold, NULL::STRUCT(f BIGINT, s DOUBLE) AS got FROM w
  UNION ALL
  SELECT conv_id, k, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.f) END, gold, got
  FROM (SELECT w.conv_id, w.k, r.taken, w.gold, list_filter(wishes, lambda x: NOT list_contains(r.taken, x.f))[1] AS got FROM r JOIN w ON w.conv_id = r.conv_id AND w.k = r.k + 1)),
a AS (SELECT conv_id AS "case", gold, got.f AS fact, got.s AS similarity FROM r WHERE got IS NOT NULL)"""


@query(f"""WITH RECURSIVE {MATCHED} SELECT "case", gold, fact, round(similarity, 6) AS similarity FROM a""")
def fact_matches(spark, sf_dir):
    """User turns take the most similar assistant turn left, in order, by token F1 with prefix equivalence, context and kind."""
    gold, runtime = conversation_facts(spark, sf_dir)
    return reference.fact_matches(gold, runtime, LEAST).withColumn("similarity", F.round("similarity", 6))


def lines_of(turns, keep):
    """Clauses of a statement as evidence: stance by the words, family by the first letter, binding by the place, quality by the length."""
    at = F.posexplode(F.split(F.coalesce("statement", F.lit("")), r"[.,\n]")).alias("line", "text")
    rows = turns.select("case", *keep, at).where("trim(text) <> ''")
    item = F.struct(
        F.lit("http://x.org/a").alias("url"), F.when(F.size(F.split(F.trim("text"), " ")) < 4, "support").otherwise("refute").alias("stance"), F.concat(F.lit("domain:"), F.substring(F.lower(F.trim("text")), 1, 1)).alias("family"),
        F.col("text"), F.lit("page").alias("kind"), F.when(F.pmod("line", F.lit(2)) == 0, "same_capture").otherwise("source_assertion").alias("binding"), F.lit(False).alias("same_capture"), F.lit(False).alias("other_capture"),
        F.lit(0.0).cast("double").alias("confidence"), F.lit("").alias("digest"), (F.char_length("text") >= 5).alias("qualified"), (F.col("line") < 3).alias("selected"), F.lit(False).alias("risky"), F.lit("direct").alias("directness"), F.lit("strong").alias("quality"),
    )
    return rows.select("case", *keep, "line", item.alias("item"))


def chains(spark, sf_dir):
    gold, runtime = conversation_facts(spark, sf_dir)
    found = reference.fact_matches(gold, runtime, LEAST)
    evidence = lines_of(runtime, ["fact"]).withColumn("evidence", F.concat_ws(":", F.col("fact").cast("string"), F.col("line").cast("string")))
    references = lines_of(gold, ["gold"]).select("case", "gold", F.col("line").alias("place"), F.concat_ws(":", F.col("gold").cast("string"), F.col("line").cast("string")).alias("source"), F.col("item").alias("reference"))
    rows, matches = reference.reference_chains(gold, runtime, found, evidence.select("case", "fact", "evidence"), evidence.select("case", "evidence", "item"), references)
    return gold, rows, matches, evidence.where("item.selected").select("case", "evidence")


LINES = r"""x AS (SELECT conv_id, turn, role, line - 1 AS line, text, CASE WHEN len(string_split(trim(text), ' ')) < 4 THEN 'support' ELSE 'refute' END AS stance, left(lower(trim(text)), 1) AS family,
  CASE WHEN line % 2 = 1 THEN 'same_capture' ELSE 'source_assertion' END AS binding, length(text) >= 5 AS qualified, line <= 3 AS selected, turn::VARCHAR || ':' || (line - 1)::VARCHAR AS id,
  regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS flat, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS norm
  FROM (SELECT conv_id, turn, role, unnest(string_split_regex(coalesce(text, ''), '[.,\n]')) AS text, generate_subscripts(string_split_regex(coalesce(text, ''), '[.,\n]'), 1) AS line FROM conversations) WHERE trim(text) <> ''),
q AS (SELECT a."case", a.gold, e.id AS evidence, v.line AS place, v.id AS source, e.qualified, e.flat AS ef, v.flat AS vf, e.norm AS en, v.norm AS vn, """ + STEMS.format("e.text") + " AS el, " + STEMS.format("v.text") + r""" AS vl
      FROM a JOIN x e ON e.conv_id = a."case" AND e.turn = a.fact AND e.role = 'assistant' JOIN x v ON v.conv_id = a."case" AND v.turn = a.gold AND v.role = 'user' AND v.stance = e.stance AND v.family = e.family AND e.family <> ''),
o AS (
  SELECT "case", gold, evidence, place, el, vl AS r, vl, 1 AS i, 0 AS n FROM q
  UNION ALL
  SELECT "case", gold, evidence, place, el, CASE WHEN hit IS NULL THEN r ELSE list_filter(r, lambda v: v <> hit) END, vl, i + 1, n + CASE WHEN hit IS NULL THEN 0 ELSE 1 END
  FROM (SELECT *, list_filter(r, lambda v: v = el[i] OR (least(length(v), length(el[i])) >= 6 AND abs(length(v) - length(el[i])) <= 2 AND (starts_with(v, el[i]) OR starts_with(el[i], v))))[1] AS hit FROM o WHERE i <= len(el))),
z AS (SELECT q.*, CASE WHEN len(q.el) = 0 OR len(q.vl) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / (len(q.el) + len(q.vl)) END AS f1, CASE WHEN len(q.vl) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(q.el, q.vl))::DOUBLE / len(q.vl) END AS recall
      FROM q JOIN o ON q."case" = o."case" AND q.gold = o.gold AND q.evidence = o.evidence AND q.place = o.place AND o.i = len(o.el) + 1),
k AS (SELECT *, CASE WHEN contains(ef, vf) OR contains(vf, ef) THEN 0 WHEN qualified AND (contains(en, vn) OR contains(vn, en) OR f1 >= 0.72 OR recall >= 0.85) THEN 1 WHEN qualified AND f1 >= 0.45 THEN 2 END AS rank,
      CASE WHEN contains(ef, vf) OR contains(vf, ef) THEN 1.0::DOUBLE WHEN contains(en, vn) OR contains(vn, en) OR f1 >= 0.72 OR recall >= 0.85 THEN greatest(0.72::DOUBLE, f1, recall) ELSE f1 END AS confidence FROM z),
d AS (SELECT "case", gold, evidence, source, rank, round(confidence, 6) AS confidence FROM k WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "case", gold, evidence ORDER BY least(rank, 1), place) = 1),
h AS (SELECT d."case", d.gold, x.family, x.stance, x.binding FROM d JOIN x ON x.conv_id = d."case" AND x.id = d.evidence AND x.role = 'assistant'),
n AS (SELECT a."case", a.gold, x.id AS evidence FROM a JOIN x ON x.conv_id = a."case" AND x.turn = a.fact AND x.role = 'assistant' WHERE x.selected AND x.qualified AND (a."case", a.gold, x.id) NOT IN (SELECT ("case", gold, evidence) FROM d)
      AND EXISTS (SELECT 1 FROM h WHERE h."case" = a."case" AND h.gold = a.gold AND h.family = x.family AND h.family <> '') AND EXISTS (SELECT 1 FROM h WHERE h."case" = a."case" AND h.gold = a.gold AND h.stance = x.stance)
      AND EXISTS (SELECT 1 FROM h WHERE h."case" = a."case" AND h.gold = a.gold AND h.binding <> x.binding)),
b AS (SELECT "case", gold, evidence, source, ['canonical_reference', 'same_source_text_equivalent', 'same_url_semantic_span'][rank + 1] AS method, confidence FROM d UNION ALL SELECT "case", gold, evidence, '', 'same_source_chain_complement', 1.0 FROM n)"""


@query(f"""WITH RECURSIVE {MATCHED}, {LINES} SELECT "case", gold, evidence, source, method, confidence::DOUBLE AS confidence FROM b""")
def reference_evidence(spark, sf_dir):
    """By what tier each clause of a matched assistant turn recovers a clause of the user turn, or completes one that does."""
    return chains(spark, sf_dir)[2]


@query(f"""WITH RECURSIVE {MATCHED}, {LINES},
told AS (
  SELECT u.conv_id AS "case", u.turn AS gold, a.fact, round(coalesce(a.similarity, 0), 6) AS similarity, coalesce(f.status = u.status, false) AS status_match,
         a.fact IS NOT NULL AND (u.kind <> 'several' OR EXISTS (SELECT 1 FROM x WHERE x.conv_id = u.conv_id AND x.turn = a.fact AND x.role = 'assistant' AND (x.binding = 'same_capture' OR f.status = 'refuted'))) AS anchor_recovered,
         (SELECT count(*) FROM b WHERE b."case" = u.conv_id AND b.gold = u.turn) AS n_evidence
  FROM t u LEFT JOIN a ON a."case" = u.conv_id AND a.gold = u.turn LEFT JOIN t f ON f.conv_id = u.conv_id AND f.turn = a.fact WHERE u.role = 'user')
SELECT *, status_match AND anchor_recovered AND n_evidence > 0 AS chain_recovered FROM told""")
def reference_chain_rows(spark, sf_dir):
    """Of each user turn what its chain recovers: the fact, its status, its tie to the picture and its evidence."""
    return chains(spark, sf_dir)[1]


@query()
def reference_chain_metrics(spark, sf_dir):
    """The four rates of each conversation; tested against a loop over cases."""
    gold, rows, matches, selected = chains(spark, sf_dir)
    return reference.chain_metrics(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case")), rows, matches, selected)
