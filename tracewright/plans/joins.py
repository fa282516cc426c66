"""Join queries: checked and verified joins, aliases, coverage, as-of, components and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.functions.hashing import seeded_hex, uniform
from tracewright.operators import checks, select, splits
from tracewright.plans.registry import load, query


@query("SELECT c_nationkey, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def ref_checked_join(spark, sf_dir):
    """J1, J2, and of J3 and J19 the checks: chained joins to tables whose keys are unique and cover every row."""
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = checks.checked_join(load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), customer, ["o_custkey"])
    return checks.checked_join(rows, nation, ["c_nationkey"]).groupBy("c_nationkey", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(status, 'attempts_exhausted') AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, 'served' AS status FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_default(spark, sf_dir):
    """Every target, with a default row where nothing was found."""
    found = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders")).withColumn("status", F.lit("served"))
    return checks.left_default(load(spark, sf_dir, "customer").select("c_custkey"), found, ["c_custkey"], {"n_orders": 0, "status": "attempts_exhausted"})


@query("""
WITH c AS (SELECT l_orderkey AS k, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS s FROM lineitem GROUP BY 1),
j AS (SELECT CASE WHEN o_orderkey IS NULL THEN 'not_wanted' WHEN c.k IS NULL THEN 'not_cached' WHEN o_orderstatus IS DISTINCT FROM c.s THEN 's_mismatch' ELSE '' END AS reason FROM orders FULL JOIN c ON o_orderkey = c.k),
r AS (SELECT reason, unnest(CASE reason WHEN 'not_wanted' THEN ['orphan'] WHEN 'not_cached' THEN ['missing'] WHEN '' THEN ['resolved'] ELSE ['rejected', 'orphan'] END) AS route FROM j)
SELECT route, reason, count(*) AS n FROM r GROUP BY 1, 2""")
def orphan_reject_resolve(spark, sf_dir):
    """J6, counted by route: every order's status against that of its lines, routed to resolved, rejected, missing and orphan."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(low == high, low).otherwise("P").alias("s"))
    return checks.verified_join(orders, lines, ["k"], ["s"]).groupBy("route", "reason").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT o_custkey, s FROM (SELECT DISTINCT o_custkey FROM orders), range(4) r(s)),
a AS (SELECT o_custkey, o_orderkey % 5 AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CASE WHEN e.s IS NULL THEN 'unexpected' WHEN a.s IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'filled' END AS state, count(*) AS n
FROM e FULL JOIN a ON e.o_custkey = a.o_custkey AND e.s = a.s GROUP BY 1""")
def slot_coverage(spark, sf_dir):
    """J16, J17, and J5 by a grid: an expected grid against what is there."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.pmod("o_orderkey", F.lit(5)).alias("s"))
    grid = orders.select("o_custkey").distinct().withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return checks.slot_coverage(grid, orders, ["o_custkey", "s"]).groupBy("state").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT s_suppkey AS c, unnest([s_suppkey::VARCHAR, 'S' || (s_suppkey % 40), upper(s_name)]) AS alias FROM supplier),
o AS (SELECT alias, count(DISTINCT c) AS n, min(c) AS c FROM t WHERE alias <> '' GROUP BY 1)
SELECT alias, c AS canonical FROM o WHERE n = 1""")
def alias_resolution(spark, sf_dir):
    """Aliases that name one row only."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return checks.alias_index(rows, "s_suppkey", [F.concat(F.lit("S"), F.pmod("s_suppkey", F.lit(40)).cast("string")), F.upper("s_name")])[0]


@query("""
WITH r AS (SELECT doc_id, coalesce(lang, '') || ':' || coalesce(source, '') || ':' || (n_chars // 50) AS key, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, key, n_labels FROM r JOIN (SELECT key, count(DISTINCT quality) AS n_labels FROM r GROUP BY 1 HAVING count(DISTINCT quality) > 1) USING (key)""")
def label_conflict_quarantine(spark, sf_dir):
    """All documents, labelled or not, under a key (language, source and length by fifties) under which labels disagree."""
    key = F.concat_ws(":", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.floor(F.col("n_chars") / 50).cast("string"))
    rows = load(spark, sf_dir, "documents").select("doc_id", key.alias("key")).join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", "key").join(checks.conflicting(rows, "key", "quality"), "key")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')
  AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 AND s_nationkey IS NOT NULL)""")
def forbidden_anti_join(spark, sf_dir):
    """Anti joins against several forbidden sets."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    poor = load(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return rows.join(urgent, "c_custkey", "left_anti").join(poor, "c_nationkey", "left_anti").select("c_custkey")


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT l.event_id, epoch_us(r.ts) AS click_us, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_event(spark, sf_dir):
    """Extension: the last click at or before each purchase."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), "value")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return checks.asof_join(buys, clicks, ["user_id"], "ts", "click_ts", ["value"]).select("event_id", F.unix_micros("click_ts").alias("click_us"), "value")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS digest, source || ':' || (n_chars // 50) AS shape FROM documents),
e AS (SELECT a.doc_id AS a, b.m AS b FROM d a JOIN (SELECT digest, min(doc_id) AS m FROM d GROUP BY 1) b USING (digest)
      UNION SELECT a.doc_id, b.m FROM d a JOIN (SELECT shape, min(doc_id) AS m FROM d GROUP BY 1) b USING (shape)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.a)
SELECT a AS id, min(c) AS component FROM r GROUP BY a""")
def components_split(spark, sf_dir):
    """G1, with the least id as the group's (not the digests of G2 and G6): documents that share a text or a shape are one group, transitively."""
    shape = F.concat_ws(":", "source", F.floor(F.col("n_chars") / 50).cast("string"))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), shape.alias("shape"))
    return splits.grouped_by_keys(rows, "doc_id", ["digest", "shape"])


@query("""
WITH d AS (SELECT sha256(text) AS digest, CASE WHEN ('0x' || substr(sha256('leak:' || doc_id), 1, 12))::BIGINT / 281474976710656.0 < 0.5 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT digest, count(DISTINCT split) AS n_splits, count(*) AS n FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage_audit(spark, sf_dir):
    """Groups that a split cuts."""
    split = F.when(uniform(seeded_hex("leak", "doc_id")) < 0.5, "train").otherwise("test")
    rows = load(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), split.alias("split"))
    return splits.leaks(rows, "digest", "split")


@query("""
WITH d AS (SELECT doc_id, source, contains(text, '@') AS bad FROM documents)
SELECT source, count(*) AS n FROM d WHERE source NOT IN (SELECT source FROM d WHERE bad) GROUP BY 1""")
def transitive_exclusion(spark, sf_dir):
    """A bad row excludes its whole group."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", F.contains("text", F.lit("@")).alias("bad"))
    return splits.excluded_groups(rows, "source", "bad").groupBy("source").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, list_filter(['large', 'cheap', 'late', 'returned'], lambda x: CASE x WHEN 'large' THEN l_quantity > 45 WHEN 'cheap' THEN l_extendedprice < 5000 WHEN 'late' THEN l_linestatus = 'O' ELSE l_returnflag = 'R' END) AS reasons FROM lineitem)
SELECT l_orderkey, l_linenumber, reasons, coalesce(reasons[1], 'ok') AS first_reason FROM r""")
def reason_codes(spark, sf_dir):
    """P13, P14, P15, and four of the rules of D23: all broken rules of a row in order, and the first."""
    q, price = F.col("l_quantity") <= 45, F.col("l_extendedprice") >= 5000
    rules = {"large": q, "cheap": price, "late": F.col("l_linestatus") != "O", "returned": F.col("l_returnflag") != "R"}
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", checks.all_failures(rules).alias("reasons"), checks.first_failure(rules).alias("first_reason"))


@query("""
SELECT doc_id, CASE WHEN coalesce(quality, 0) = 0 OR toxic = 1 THEN 'error' WHEN n_chars < 200 THEN 'short' ELSE 'success' END AS status,
       CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'mixed' ELSE 'wrong' END AS category FROM documents LEFT JOIN labels USING (doc_id)""")
def status_and_category(spark, sf_dir):
    """Derived status and a category that is null where it cannot be judged."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when((F.coalesce("quality", F.lit(0)) == 0) | (F.col("toxic") == 1), "error").when(F.col("n_chars") < 200, "short").otherwise("success")
    category = F.when(F.col("quality").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "mixed").otherwise("wrong")
    return rows.select("doc_id", status.alias("status"), category.alias("category"))


@query("""
WITH t AS (SELECT conv_id, turn, role, lead(turn) OVER w AS nxt, lead(role) OVER w AS who FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id, turn, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) AS ids FROM conversations),
p AS (SELECT t.conv_id, t.turn, a.ids AS prompt, b.ids AS completion FROM t JOIN c a ON a.conv_id = t.conv_id AND a.turn = t.turn JOIN c b ON b.conv_id = t.conv_id AND b.turn = t.nxt WHERE t.role = 'user' AND t.who = 'assistant')
SELECT conv_id, turn, list_transform(range(len(completion)), lambda i: len(prompt) + i - 1) AS positions, (list_concat(prompt, completion))[1:-2] AS input FROM p""")
def causal_shift(spark, sf_dir):
    """For each user turn and the assistant turn right after it, the whole input without its last token, and the loss positions.

    Turns are numbered over the whole table in their order, so that neighbours meet in an equi-join however long a conversation is.
    """
    turns = load(spark, sf_dir, "conversations")
    placed = select.global_rank(turns.select(F.struct("conv_id", "turn", "role").alias("at")), "at").select("at.*", "rank")
    answers = placed.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"), (F.col("rank") - 1).alias("rank"))
    found = placed.where("role = 'user'").join(answers, ["conv_id", "rank"]).select("conv_id", "turn", "answer")
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    pairs = found.join(turns.select("conv_id", "turn", ids.alias("prompt")), ["conv_id", "turn"])
    pairs = pairs.join(turns.select("conv_id", F.col("turn").alias("answer"), ids.alias("completion")), ["conv_id", "answer"])
    return pairs.select("conv_id", "turn", arrays.causal_targets(F.col("prompt"), F.col("completion")).alias("positions"), arrays.causal_input(F.col("prompt"), F.col("completion")).alias("input"))
