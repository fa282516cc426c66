"""Further queries: bins, cohorts, lookups, lineage, group samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tracewright.functions import html, text, urls
from tracewright.functions.hashing import seeded_hex, short_id
from tracewright.operators.select import global_rank
from tracewright.plans.registry import load, query


@query("SELECT CASE WHEN n <= 3 THEN '0-3' WHEN n <= 5 THEN '4-5' WHEN n > 5 THEN '6+' ELSE 'unknown' END AS bin, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def count_bins(spark, sf_dir):
    """Cases by how many steps they have."""
    steps = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    label = F.when(F.col("k") <= 3, "0-3").when(F.col("k") <= 5, "4-5").when(F.col("k") > 5, "6+").otherwise("unknown")
    return load(spark, sf_dir, "orders").select("o_orderkey").join(steps, "o_orderkey", "left").groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS cases, count(DISTINCT c_mktsegment) AS segments, max(k) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) GROUP BY 1")
def cohort_description(spark, sf_dir):
    """Cases, distinct groups and group sizes of a cohort."""
    sizes = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k"))
    return sizes.groupBy("c_nationkey").agg(F.sum("k").alias("cases"), F.count("*").alias("segments"), F.max("k").alias("largest"))


@query("SELECT l_returnflag AS kind, count(*) AS positions, count(DISTINCT l_orderkey) AS targets, round(sum(l_discount), 4) AS mass, round(sum(l_discount) / sum(sum(l_discount)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def mass_by_kind(spark, sf_dir):
    """Positions, targets, mass and share by kind; the window is over one row for each kind."""
    kinds = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("positions"), F.countDistinct("l_orderkey").alias("targets"), F.sum("l_discount").alias("m"))
    share = F.round(F.col("m") / F.sum("m").over(Window.partitionBy()), 6)
    return kinds.select("kind", "positions", "targets", F.round("m", 4).alias("mass"), share.alias("share"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
m AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS median FROM r WHERE k <= 20 GROUP BY 1, 2)
SELECT event_type, round(max(median) - min(median), 6) AS imbalance, count(*) FILTER (WHERE median < 5) AS below_target FROM m GROUP BY 1""")
def rolling_median_imbalance(spark, sf_dir):
    """Medians of the last rows, against a target and each other."""
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    last = load(spark, sf_dir, "events").withColumn("k", place).where("k <= 20")
    medians = last.groupBy("user_id", "event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    return medians.groupBy("event_type").agg(F.round(F.max("median") - F.min("median"), 6).alias("imbalance"), F.count_if(F.col("median") < 5).alias("below_target"))


@query("SELECT event_type, coalesce(event_type IN ('purchase', 'click') AND value > 5 OR event_type = 'view' AND value > 20, false) AS can_decide, count(*) AS n FROM events GROUP BY 1, 2")
def capability_matrix(spark, sf_dir):
    """P25: what may decide a claim, by a lookup of bounds."""
    bounds = spark.range(1).select(F.explode(F.create_map(F.lit("purchase"), F.lit(5.0), F.lit("click"), F.lit(5.0), F.lit("view"), F.lit(20.0))).alias("event_type", "bound"))
    rows = load(spark, sf_dir, "events").join(F.broadcast(bounds), "event_type", "left")
    return rows.groupBy("event_type", F.coalesce(F.col("value") > F.col("bound"), F.lit(False)).alias("can_decide")).agg(F.count("*").alias("n"))


@query()
def blocked_domain_in_text(spark, sf_dir):
    """P20: the longest of some domains that a page's whole source names at its boundaries, percent signs decoded; tested against a loop."""
    return load(spark, sf_dir, "pages").select("page_id", urls.named_domain(F.col("html"), ["example.org", "example.com", "en.example.org"]).alias("blocked_by"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(t, '{x}') THEN '{x}'" for x in html.BLOCKED) + r""" ELSE '' END AS blocked_by
FROM (SELECT page_id, lower(regexp_replace(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM pages)""")
def blocked_pages(spark, sf_dir):
    """The first sign of an access wall in a page's whole source."""
    return load(spark, sf_dir, "pages").select("page_id", html.blocked_by(F.col("html")).alias("blocked_by"))


@query(r"""
WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+')), lambda w: len(w) > 1 AND w NOT IN ('a','an','and','are','as','at','be','by','does','for','from','in','is','it','of','on','or','the','this','to','what','when','where','which','who','with')) AS w
           FROM conversations)
SELECT conv_id, turn, len(w) < 3 AS low_value FROM t""")
def low_value_queries(spark, sf_dir):
    """Texts of any script with hardly a word that is not a stopword; a null text has none."""
    rows = load(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", (F.size(text.ranking_tokens(F.col("text"))) < 3).alias("low_value"))


@query("""
WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), n AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1)
SELECT conv_id, word FROM w JOIN n USING (conv_id) GROUP BY conv_id, word, k HAVING count(*) = k""")
def common_to_all(spark, sf_dir):
    """U9, the intersection: what every member of a group has, by counting rather than by gathering sets."""
    rows = load(spark, sf_dir, "conversations")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("word")
    held = rows.select("conv_id", words).groupBy("conv_id", "word").agg(F.count("*").alias("c"))
    return held.join(rows.groupBy("conv_id").agg(F.count("*").alias("k")), "conv_id").where("c = k").select("conv_id", "word")


@query("SELECT lang, count(*) AS n, count(DISTINCT sha256(text)) AS stored, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def content_addressed(spark, sf_dir):
    """U7, counts: rows, and the contents that a store by digest would hold."""
    rows = load(spark, sf_dir, "documents").select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "n_chars")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("stored"), F.sum("n_chars").alias("chars"))


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT c_custkey, p_partkey FROM a LEFT JOIN b USING (k)")
def positional_zip(spark, sf_dir):
    """Two tables joined by position."""
    left = global_rank(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    right = global_rank(load(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return left.join(right, "rank", "left").select("c_custkey", "p_partkey")


@query("""
SELECT o_orderkey, bool_and(coalesce(p_size > 0 AND s_acctbal > -1000 AND n_regionkey IS NOT NULL, false)) AS valid, count(*) AS hops FROM orders JOIN lineitem ON l_orderkey = o_orderkey
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def multi_hop_validation(spark, sf_dir):
    """J14, three of its conditions: a case holds when every hop of every reference does."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    rows = rows.join(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    rows = rows.join(load(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "left").join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "left")
    rows = rows.join(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey", "left")
    ok = F.coalesce((F.col("p_size") > 0) & (F.col("s_acctbal") > -1000) & F.col("n_regionkey").isNotNull(), F.lit(False))
    return rows.groupBy("o_orderkey").agg(F.bool_and(ok).alias("valid"), F.count("*").alias("hops"))


@query("SELECT l_orderkey, l_linenumber, substr(sha256('repair:' || l_orderkey || ':' || l_linenumber || ':' || sha256(l_partkey::VARCHAR)), 1, 24) AS target_id FROM lineitem WHERE l_returnflag = 'R'")
def target_ids(spark, sf_dir):
    """D6, and the ids of D21: content ids of targets, from kind, case, step and digest."""
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    part = F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256)
    return rows.select("l_orderkey", "l_linenumber", short_id(F.concat_ws(":", F.lit("repair"), "l_orderkey", "l_linenumber", part), 24).alias("target_id"))


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS k, sha256('groups:' || c_mktsegment) AS h FROM customer GROUP BY 1, 2),
r AS (SELECT *, sum(k) OVER (PARTITION BY c_nationkey ORDER BY h, c_mktsegment) AS upto, sum(k) OVER (PARTITION BY c_nationkey) AS total FROM g)
SELECT c_nationkey, c_mktsegment, k::BIGINT AS n FROM r WHERE upto <= 0.5 * total""")
def whole_group_sample(spark, sf_dir):
    """In place of G7 and G14, by a running sum: whole groups in hash order while they fit a share of their stratum."""
    groups = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy(seeded_hex("groups", "c_mktsegment"), "c_mktsegment")
    upto, total = F.sum("n").over(w), F.sum("n").over(Window.partitionBy("c_nationkey"))
    return groups.withColumn("fits", upto <= 0.5 * total).where("fits").drop("fits")
