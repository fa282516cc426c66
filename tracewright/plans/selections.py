"""Selection queries: best of N, first and last, quotas, splits, shards, rollout grids, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.hashing import seeded_hex, shard
from tracewright.operators import exact, select, series
from tracewright.plans.registry import load, query


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, -l_quantity, l_discount, l_linenumber, l_partkey) = 1""")
def best_of_n(spark, sf_dir):
    """The best row of each case by a lexicographic rank that ends with its id."""
    rank = [F.col("l_returnflag"), -F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"), F.col("l_partkey")]
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount")
    return select.best_per_key(rows, ["l_orderkey"], rank).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT l_orderkey, l_linenumber, 'superseded' AS reason FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity, l_linenumber) > 1""")
def superseded_losers(spark, sf_dir):
    """T4: all but the winner of each case, with the reason."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    return select.losers(rows, ["l_orderkey"], [F.col("l_discount"), F.col("l_quantity"), F.col("l_linenumber")], "superseded").select("l_orderkey", "l_linenumber", "reason")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def longest_per_case(spark, sf_dir):
    """T5: the longest of each case, ties by id."""
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return select.best_per_key(rows, ["source"], [-F.col("n_chars"), F.col("doc_id")])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_per_key(spark, sf_dir):
    """The first row of each key in source order."""
    return select.best_per_key(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    """The last row of each key wins."""
    return select.best_per_key(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [-F.col("event_id")])


@query("""
WITH a AS (SELECT user_id, event_id, event_type, count(*) OVER u AS attempts, count(*) FILTER (WHERE event_type = 'error') OVER u AS failures,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END) AS k
           FROM events WINDOW u AS (PARTITION BY user_id))
SELECT user_id, event_id, event_type, attempts, failures FROM a WHERE k = 1""")
def retry_merge(spark, sf_dir):
    """The first attempt that did not fail, else the last."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return select.retry_merge(rows, ["user_id"], "event_id", F.col("event_type") == "error")


@query("""
SELECT position::INT AS position, o_orderkey, o_custkey, o_totalprice FROM (SELECT generate_subscripts(l, 1) - 1 AS position, unnest(l) AS o_orderkey FROM (SELECT [96, 3, 33, 7, 1] AS l))
JOIN orders USING (o_orderkey)""")
def select_by_list(spark, sf_dir):
    """An explicit list of ids, in its order."""
    return select.by_list(load(spark, sf_dir, "orders"), "o_orderkey", [96, 3, 33, 7, 1]).select("position", "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rank FROM customer) WHERE rank % 7 = 2")
def shard_modulo(spark, sf_dir):
    """P5: every n-th row by id, ranked in range partitions."""
    return select.modulo_shard(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, 2)


@query("SELECT ('0x' || substr(sha256(doc_id::VARCHAR), 57, 8))::BIGINT::INT % 4 AS shard, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1".replace("::INT % 4", " % 4"))
def hash_shards(spark, sf_dir):
    """Shards by the digest of the id."""
    return load(spark, sf_dir, "documents").groupBy(shard("doc_id", 4).cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT c_custkey, sha256('pilot:' || c_custkey) AS order_key FROM customer ORDER BY 2 LIMIT 100")
def hash_sample(spark, sf_dir):
    """The first n in the order of sha256(salt:id)."""
    return select.hash_sample(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "pilot", 100)


@query("""
SELECT c_mktsegment, c_nationkey, c_custkey FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256('balance:' || c_custkey), c_custkey) <= 3""")
def balanced_quota(spark, sf_dir):
    """The same quota from each stratum, in hash order."""
    rows = load(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    return select.stratum_quota(rows, "c_custkey", ["c_mktsegment", "c_nationkey"], "balance", 3).drop("place")


@query("""
SELECT doc_id, quality, turn FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('plan' || chr(0) || doc_id), doc_id) AS turn FROM labels)
ORDER BY turn, quality LIMIT 60""")
def alternating_balanced(spark, sf_dir):
    """Classes take turns, each in hash order."""
    return select.alternating(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", "plan", 60)


@query("""
WITH u AS (SELECT doc_id, source, ('0x' || substr(sha256('split:' || source), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents)
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT source) AS groups FROM u GROUP BY 1""")
def ratio_split(spark, sf_dir):
    """Splits by the uniform hash of a row's group."""
    rows = select.ratio_split(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "split", {"train": 0.8, "validation": 0.1, "test": 0.1})
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("groups"))


@query("""
WITH g AS (SELECT s_suppkey, i::INT AS rollout_index, sha256('grid:' || s_suppkey || ':' || i) AS h FROM supplier, range(3) r(i))
SELECT s_suppkey, rollout_index, substr(sha256('grid:' || s_suppkey), 1, 16) AS prompt_group_id, ('0x' || substr(h, 1, 8))::BIGINT & 2147483647 AS sampling_seed, substr(h, 1, 20) AS episode_id FROM g""")
def rollout_grid(spark, sf_dir):
    """N rollouts for each case with group id, seed and episode id."""
    return select.rollout_grid(load(spark, sf_dir, "supplier"), "s_suppkey", 3, "grid")


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)
SELECT doc_id, n_chars, rank FROM r WHERE (rank % greatest((n - 1) // 15, 1) = 0 AND rank / greatest((n - 1) // 15, 1) < 16) OR rank >= n - 4""")
def evenly_spaced_picks(spark, sf_dir):
    """Picks at evenly spaced ranks, and the largest."""
    return select.evenly_spaced(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 4)


@query("""
SELECT doc_id, score FROM (SELECT doc_id, (length(t) - length(replace(t, 'the', ''))) // 3 + (length(t) - length(replace(t, 'and', ''))) // 3 AS score FROM (SELECT doc_id, lower(text) AS t FROM documents))
WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 12""")
def keyword_recall(spark, sf_dir):
    """The k rows with most occurrences of the terms."""
    from tracewright.functions.text import occurrences

    text = F.lower("text")
    score = occurrences(text, F.lit("the")) + occurrences(text, F.lit("and"))
    return load(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("doc_id")).limit(12)


@query("""
SELECT c_custkey, coalesce(r, 1000000) AS place FROM customer LEFT JOIN (SELECT o_custkey, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def rerank_merge(spark, sf_dir):
    """An external order first, the unranked after it.

    Totals are added in the order of o_orderkey, the order of the table: customers with the same sum often differ in its last bit,
    and would change places with every other order of addition.
    """
    from pyspark.sql import Window

    from tracewright.operators.select import global_rank

    upto = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum("o_totalprice").over(upto).alias("total"))
    totals = sums.groupBy("o_custkey").agg(F.max_by("total", "o_orderkey").alias("total"))
    ranked = global_rank(totals.withColumn("k", F.struct(-F.col("total"), F.col("o_custkey"))), "k").select(F.col("o_custkey").alias("c_custkey"), (F.col("rank") + 1).alias("r"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(ranked, "c_custkey", "left").select("c_custkey", F.coalesce("r", F.lit(1000000)).alias("place"))


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_left,
       (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS n_right, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_any""")
def set_overlap_report(spark, sf_dir):
    """Sizes of intersection, differences and union, in one aggregation by key."""
    orders = load(spark, sf_dir, "orders")
    sides = orders.groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("a"), F.max(F.col("o_orderstatus") == "O").alias("b"))
    a, b = F.col("a"), F.col("b")
    return sides.agg(F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_left"), F.count_if(b & ~a).alias("n_right"), F.count_if(a | b).alias("n_any"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'primary' ELSE 'supplement' END AS source_tag FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def disjoint_union(spark, sf_dir):
    """U10, and U1 and U2 without their counts: a union of two sources that may not overlap, with a source tag."""
    from tracewright.operators.checks import require_unique

    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    first = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("primary").alias("source_tag"))
    second = orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("supplement").alias("source_tag"))
    return require_unique(first.unionByName(second), ["o_orderkey"], "union")


@query("""
WITH t AS (SELECT c_custkey FROM customer), done AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), failed AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT CASE WHEN c_custkey IN (FROM done) THEN 'completed' WHEN c_custkey IN (FROM failed) THEN 'deferred' ELSE 'unattempted' END AS state, count(*) AS n FROM t GROUP BY 1""")
def unattempted_work(spark, sf_dir):
    """What is done, deferred, and left to do."""
    seen = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderstatus") == "F").alias("done"), F.max(F.col("o_orderstatus") == "P").alias("failed"))
    state = F.when(F.col("done"), "completed").when(F.col("failed"), "deferred").otherwise("unattempted")
    return load(spark, sf_dir, "customer").join(seen, "c_custkey", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events""")
def moving_average(spark, sf_dir):
    """Trailing mean with partial frames."""
    return series.moving_average(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "user_id", F.round("moving_average", 6).alias("moving_average"))


@query("""
SELECT user_id, ceil(i / 10)::BIGINT AS segment, count(*) AS n, round(avg(value), 6) AS mean, arg_min(value, i) AS first_value, arg_max(value, i) AS last_value, max(i) = ceil(max(i) / 10) * 10 AS complete
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) GROUP BY 1, 2""")
def epoch_segments(spark, sf_dir):
    """Disjoint segments with means, first and last values, completeness."""
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return series.segments(rows, ["user_id"], "i", "value", 10)


@query("""
WITH m AS (SELECT event_id, user_id, value, row_number() OVER u AS i, avg(value) OVER u AS mean FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(greatest(0, mean * i - coalesce(lag(mean) OVER (PARTITION BY user_id ORDER BY i), 0) * (i - 1)), 4) AS single FROM m""")
def decumulated_mean(spark, sf_dir):
    """Single values behind a running mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").withColumn("i", F.row_number().over(w)).withColumn("mean", F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return series.decumulate(rows, ["user_id"], ["i"], "mean", 4).select("event_id", "single")


@query("""
WITH p AS (SELECT event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prior_median,
                  count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events)
SELECT event_id, round(prior_median, 6) AS prior_median, coalesce(seen >= 4 AND prior_median > 0 AND value >= prior_median * 2 AND value - prior_median >= 0.1, false) AS is_spike FROM p""")
def spike_vs_prior_median(spark, sf_dir):
    """Values far above the median of the rows before them."""
    out = series.spikes(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 10, 2.0, 0.1)
    return out.select("event_id", F.round("prior_median", 6).alias("prior_median"), "is_spike")


@query("""
WITH p AS (SELECT event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_best FROM events)
SELECT event_id, prior_best, coalesce(prior_best > 0 AND value >= prior_best * 1.1 AND value - prior_best >= 0.02, false) AS regressed FROM p""")
def best_prior_regression(spark, sf_dir):
    """Regression against the best before."""
    return series.regressions(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 0.1, 0.02).select("event_id", "prior_best", "regressed")


@query("""
WITH e AS (SELECT user_id, event_type <> 'purchase' AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type <> 'purchase' ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, miss, g, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, max(CASE WHEN miss THEN n ELSE 0 END) AS longest_streak FROM r GROUP BY user_id""")
def longest_streak(spark, sf_dir):
    """The longest run of rows without a match."""
    return series.longest_streak(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "purchase")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'error') AS first_event_id FROM events GROUP BY user_id")
def first_error(spark, sf_dir):
    """The first qualifying event in order."""
    return series.first_event(load(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), F.col("event_type") == "error", "event_id")


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN i END) OVER (PARTITION BY user_id) AS last FROM o)
SELECT user_id, count(*) FILTER (WHERE i > last) AS n_after FROM l GROUP BY user_id""")
def post_event_actions(spark, sf_dir):
    """Rows after the last decisive one."""
    return series.after_last(load(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), F.col("event_type") == "purchase")


@query("""
SELECT event_id, round((value - lag(value) OVER u) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER u) / 1000000, 0), 6) + 0.0 AS rate FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_rate(spark, sf_dir):
    """Change of a counter per second since the row before."""
    return series.rate(load(spark, sf_dir, "events"), ["user_id"], "ts", "value", ["ts", "event_id"], 6).select("event_id", "rate")


@query("""
WITH RECURSIVE g AS (
  SELECT *, row_number() OVER (ORDER BY sha256('g3:' || "group"::VARCHAR), "group") AS i
  FROM (SELECT o_custkey AS "group", count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)),
r AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS s, []::BIGINT[] AS picked
  UNION ALL
  SELECT i, c, s, picked FROM (
    SELECT g.i, r.c + k.k * g.n AS c, r.s + k.k * g.f AS s, CASE WHEN k.k = 1 THEN list_append(picked, "group") ELSE picked END AS picked, k.k, bool_or(r.c = 60 AND r.s = 25) OVER () AS met
    FROM r JOIN g ON g.i = r.i + 1, (VALUES (0), (1)) k(k))
  WHERE NOT met AND c <= 60 AND s <= 25 QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY k) = 1)
SELECT "group", n AS count, f AS supported, list_contains((SELECT picked FROM r WHERE c = 60 AND s = 25 ORDER BY i LIMIT 1), "group") AS chosen FROM g""")
def exact_validation_groups(spark, sf_dir):
    """Whole customers that have exactly 60 orders, 25 of them filled, in seeded order."""
    orders = load(spark, sf_dir, "orders")
    groups = orders.groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("count"), F.count_if(F.col("o_orderstatus") == "F").alias("supported"))
    return exact.exact_groups(groups, "g3", 60, 25)
