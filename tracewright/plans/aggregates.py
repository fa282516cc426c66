"""Aggregation queries: summaries, confusion metrics, percentile families, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import arrays
from tracewright.operators import metrics
from tracewright.plans.registry import load, query


def labelled(spark, sf_dir):
    """Labels with a rule's prediction; a document of under 200 characters has none."""
    rule = F.when(F.col("n_chars") >= 2000, 1).when(F.col("n_chars") >= 200, 0)
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", rule.alias("pred")), "doc_id")


LABELLED = "s AS (SELECT l.doc_id, quality, toxic, lang, source, n_chars, CASE WHEN n_chars >= 2000 THEN 1 WHEN n_chars >= 200 THEN 0 END AS pred FROM labels l JOIN documents USING (doc_id))"


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(*) FILTER (WHERE event_type <> 'error') AS n_ok,
       round(coalesce(avg(value), 0), 3) AS mean_value FROM events GROUP BY user_id""")
def run_summary(spark, sf_dir):
    """A1: counts by status and the mean of the measures, 0 of nothing."""
    return metrics.run_summary(load(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "error", ["value"])


@query("""
SELECT d.v AS value, count(event_id) AS n FROM (SELECT unnest(['click','error','purchase','refund','signup','view']) AS v) d
LEFT JOIN events ON event_type = d.v GROUP BY d.v""")
def zero_filled_categories(spark, sf_dir):
    """A2: counts over a fixed domain, absent values at 0."""
    return metrics.zero_filled(load(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "refund", "signup", "view"])


@query(f"""
WITH {LABELLED}
SELECT quality AS gold, count(*) AS support, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
       count(*) FILTER (WHERE pred IS NULL) AS pred_missing FROM s GROUP BY quality""")
def confusion_with_missing(spark, sf_dir):
    """A4: confusion counts with a column for missing predictions."""
    return metrics.confusion(labelled(spark, sf_dir), "quality", "pred", [0, 1])


@query(f"""
WITH {LABELLED},
c AS (SELECT c, count(*) FILTER (WHERE quality = c AND pred = c) AS tp, count(*) FILTER (WHERE quality <> c AND pred = c) AS fp, count(*) FILTER (WHERE quality = c) AS n
      FROM s, (VALUES (0), (1)) v(c) GROUP BY c)
SELECT round(avg(CASE WHEN n > 0 THEN tp / n END), 6) AS balanced_accuracy, round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS macro_precision,
       round(avg(CASE WHEN tp + fp + n > 0 THEN 2 * tp / (tp + fp + n) ELSE 0 END), 6) AS macro_f1 FROM c""")
def macro_f1_fixed_support(spark, sf_dir):
    """Balanced accuracy, macro precision and macro F1 with missing predictions as false negatives."""
    return metrics.macro_metrics(labelled(spark, sf_dir), "quality", "pred", [0, 1])


@query(f"""
WITH {LABELLED}
SELECT lang, source, count(*) AS n, round(avg(CASE WHEN pred = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(coalesce(sum(CASE WHEN pred = quality THEN 1.0 ELSE 0.0 END) / nullif(count(pred), 0), 0), 6) AS valid_accuracy
FROM s GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def route_breakdown(spark, sf_dir):
    """Raw and valid-only accuracy by route, by class, and overall."""
    hit = F.coalesce((F.col("pred") == F.col("quality")).cast("double"), F.lit(0.0))
    sets = [[F.col("lang"), F.col("source")], [F.col("lang")], []]
    return labelled(spark, sf_dir).groupingSets(sets, F.col("lang"), F.col("source")).agg(
        F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"),
        F.round(F.coalesce(F.try_divide(F.sum(hit), F.count("pred")), F.lit(0.0)), 6).alias("valid_accuracy"),
    )


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.9), 3) AS p90,
       round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max, round(sum(value), 3) AS sum FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """Interpolated percentiles with n, mean, max and sum."""
    return metrics.describe(load(spark, sf_dir, "events"), "value", ["event_type"])


@query("""
SELECT lang, count(n_chars) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS max
FROM documents GROUP BY lang""")
def nearest_rank_lengths(spark, sf_dir):
    """Percentiles by nearest rank."""
    return metrics.nearest_rank(load(spark, sf_dir, "documents"), "n_chars", ["lang"], [0.5, 0.9, 0.99])


@query("""
SELECT source, count(*) FILTER (WHERE n_chars <= 512) AS le_512, count(*) FILTER (WHERE n_chars <= 2048) AS le_2048, count(*) FILTER (WHERE n_chars <= 8192) AS le_8192,
       count(*) FILTER (WHERE n_chars > 8192) AS gt_8192 FROM documents GROUP BY source""")
def cumulative_length_bins(spark, sf_dir):
    """Bins that overlap, and what is above the last."""
    return metrics.cumulative_bins(load(spark, sf_dir, "documents"), "n_chars", [512, 2048, 8192], ["source"])


@query("""
WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents),
b AS (SELECT max(n_chars) FILTER (WHERE i = n // 4) AS q1, max(n_chars) FILTER (WHERE i = n * 2 // 4) AS q2, max(n_chars) FILTER (WHERE i = n * 3 // 4) AS q3 FROM o)
SELECT lang, (n_chars > q1)::INT + (n_chars > q2)::INT + (n_chars > q3)::INT AS bucket, count(*) AS n FROM documents, b GROUP BY 1, 2""")
def quartile_buckets(spark, sf_dir):
    """Bounds at sorted index n * q // 4, and the number of bounds that a value exceeds."""
    docs = load(spark, sf_dir, "documents")
    bounds = metrics.quartile_bounds(docs, "n_chars")
    over = sum(((F.col("n_chars") > F.col(q)).cast("int") for q in ("q1", "q2", "q3")), F.lit(0))
    return docs.crossJoin(F.broadcast(bounds)).groupBy("lang", over.alias("bucket")).agg(F.count("*").alias("n"))  # bounds: one row


@query("""
SELECT word, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM conversations) GROUP BY word""")
def exploded_mode_counts(spark, sf_dir):
    """Rows that hold each value of a list; a row counts once for a value."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)
    return metrics.explode_counts(load(spark, sf_dir, "conversations"), words, "word")


@query("""
WITH m AS (SELECT event_type || ':value' AS metric, value AS v FROM events UNION ALL SELECT event_type || ':k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean FROM m GROUP BY metric""")
def map_metric_means(spark, sf_dir):
    """The mean of every numeric entry of a map."""
    name = lambda x: F.concat(F.col("event_type"), F.lit(f":{x}"))
    k = F.get_json_object("props", "$.k").cast("double")
    return metrics.map_means(load(spark, sf_dir, "events"), F.create_map(name("value"), F.col("value"), name("k"), k))


@query("""
SELECT user_id, count(*) AS size, count(value) FILTER (WHERE event_type <> 'error') AS valid, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean,
       round(CASE WHEN min(value) FILTER (WHERE event_type <> 'error') IS DISTINCT FROM max(value) FILTER (WHERE event_type <> 'error') THEN stddev_pop(value) FILTER (WHERE event_type <> 'error') ELSE 0 END, 6) AS std,
       skip IS NULL AS trainable, skip AS skip_reason
FROM (SELECT *, CASE WHEN count(value) FILTER (WHERE event_type <> 'error') OVER u < 20 THEN 'insufficient_valid_members'
                     WHEN min(value) FILTER (WHERE event_type <> 'error') OVER u = max(value) FILTER (WHERE event_type <> 'error') OVER u THEN 'zero_reward_variance' END AS skip
      FROM events WINDOW u AS (PARTITION BY user_id))
GROUP BY user_id, skip""")
def group_reward_stats(spark, sf_dir):
    """Size, valid members, mean, population deviation, trainability and its reason."""
    return metrics.group_stats(load(spark, sf_dir, "events"), "user_id", "value", F.col("event_type") != "error", 20)


@query("""
WITH p AS (
  SELECT o_orderkey, o_orderstatus, count(l_discount) AS n, avg(CASE WHEN l_returnflag <> 'N' THEN l_discount END) AS d, avg(l_tax) AS t, avg(CASE WHEN l_linestatus = 'F' THEN l_quantity / 50 END) AS q
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
w AS (SELECT *, (coalesce(d, 0) * 0.4 + coalesce(t, 0) * 0.4 + coalesce(q, 0) * 0.2) / nullif((d IS NOT NULL)::INT * 0.4 + (t IS NOT NULL)::INT * 0.4 + (q IS NOT NULL)::INT * 0.2, 0) AS quality FROM p)
SELECT o_orderkey, round(quality, 8) AS quality,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN 0.0 ELSE round(0.35 + 0.65 * greatest(0, least(1, coalesce(quality, 0))), 8) END AS reward FROM w""")
def weighted_present_mean(spark, sf_dir):
    """Weights renormalised over the components that are there; the outcome decides first."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg(F.when(F.col("l_returnflag") != "N", F.col("l_discount"))).alias("d"), F.avg("l_tax").alias("t"),
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 50)).alias("q"),
    )
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")
    part = lambda c, w: F.struct(F.col(c).alias("value"), F.lit(w).alias("weight"))
    rows = rows.withColumn("quality", arrays.weighted_present_mean(F.array(part("d", 0.4), part("t", 0.4), part("q", 0.2))))
    value = metrics.reward(F.col("o_orderstatus") == "F", F.coalesce("quality", F.lit(0.0)), F.col("o_orderstatus") != "P", 0.35)
    return rows.select("o_orderkey", F.round("quality", 8).alias("quality"), value.alias("reward"))


@query("""
WITH p AS (SELECT o_custkey, o_totalprice, o_orderstatus FROM orders),
u AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS calls FROM p GROUP BY 1)
SELECT c_mktsegment, count(*) AS cases, count(total) AS with_orders, round(sum(total), 2) AS total, sum(calls)::BIGINT AS calls,
       round(avg(total / calls), 4) AS mean_share FROM customer LEFT JOIN u ON o_custkey = c_custkey GROUP BY 1""")
def latency_attribution(spark, sf_dir):
    """Sums for each case from its steps, then summaries over cases."""
    each = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("calls"))
    return load(spark, sf_dir, "customer").join(each, "c_custkey", "left").groupBy("c_mktsegment").agg(
        F.count("*").alias("cases"), F.count("total").alias("with_orders"), F.round(F.sum("total"), 2).alias("total"),
        F.sum("calls").alias("calls"), F.round(F.avg(F.col("total") / F.col("calls")), 4).alias("mean_share"),
    )


@query("""
SELECT l_shipmode_status AS status, l_returnflag, sum(l_quantity) AS quantity, count(*) AS n, grouping(l_shipmode_status, l_returnflag) AS level
FROM (SELECT l_linestatus AS l_shipmode_status, * FROM lineitem) GROUP BY CUBE (l_shipmode_status, l_returnflag)""")
def grouping_sets(spark, sf_dir):
    """Extension: a cube with its grouping level."""
    rows = load(spark, sf_dir, "lineitem").withColumn("status", F.col("l_linestatus"))
    return rows.cube("status", "l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""
SELECT digest, count(DISTINCT source) AS n_sources, count(*) AS n, min(doc_id) AS first_doc
FROM (SELECT sha256(text) AS digest, source, doc_id FROM documents) GROUP BY digest HAVING count(DISTINCT source) > 1""")
def result_collision_audit(spark, sf_dir):
    """One result digest under several identities."""
    rows = load(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "source", "doc_id")
    out = rows.groupBy("digest").agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return out.where("n_sources > 1")


@query("""
WITH s AS (SELECT 'documents' AS source, n_chars AS size FROM documents UNION ALL SELECT 'pages', length(html) FROM pages UNION ALL SELECT 'conversations', length(text) FROM conversations)
SELECT source, count(*) AS n, sum(size)::BIGINT AS total, max(size) AS longest, count(*) FILTER (WHERE size > 1000) AS n_long, round(count(*) FILTER (WHERE size > 1000) / count(*), 6) AS share_long FROM s GROUP BY source""")
def sources_side_by_side(spark, sf_dir):
    """Several sources, tagged, summarised side by side."""
    docs = load(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("n_chars").alias("size"))
    pages = load(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.char_length("html").cast("long").alias("size"))
    talks = load(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.char_length("text").cast("long").alias("size"))
    long = F.count_if(F.col("size") > 1000)
    return docs.unionByName(pages).unionByName(talks).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("longest"), long.alias("n_long"), F.round(long / F.count("*"), 6).alias("share_long")
    )


@query("""
SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS max,
       count(value) AS n, round(stddev_pop(value) / avg(value), 6) AS variation, count(*) FILTER (WHERE value > 1.5 * m) AS stalls
FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type""")
def step_time_profile(spark, sf_dir):
    """A24, and of A25 the distribution: mean, median, p90, variation and stalls over 1.5 medians."""
    from tracewright.operators import series

    return series.step_profile(load(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""
WITH {LABELLED}
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS usable, count(*) FILTER (WHERE pred IS NULL) AS no_prediction, count(*) FILTER (WHERE pred <> quality) AS wrong,
       count(DISTINCT source) AS sources, min(n_chars) AS shortest, max(n_chars) AS longest FROM s""")
def conditional_counts(spark, sf_dir):
    """A3, and in part A17 and A18: many conditional counts in one pass."""
    return labelled(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("usable"), F.count_if(F.col("pred").isNull()).alias("no_prediction"),
        F.count_if(F.col("pred") != F.col("quality")).alias("wrong"), F.countDistinct("source").alias("sources"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
    )
