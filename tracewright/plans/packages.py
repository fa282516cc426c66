"""Packages of training rows: catalogues, and rebuilt bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import catalogue, rebuild
from tracewright.plans.registry import load, query
from tracewright.session import Scratch


@query("""
WITH RECURSIVE l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
c AS (SELECT d.doc_id, sha256(coalesce(text, '')) AS digest, coalesce(lang, '') || '-' || coalesce(source, '') || '-' || (n_chars // 20) AS episode, coalesce(quality = 1, false) AS selected, toxic,
             octet_length(encode(coalesce(text, ''))) AS size FROM documents d LEFT JOIN l USING (doc_id)),
o AS (SELECT *, row_number() OVER (ORDER BY selected DESC, doc_id) AS k FROM c),
r AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS seen, NULL::BIGINT AS doc_id
  UNION ALL
  SELECT o.k, CASE WHEN hit THEN seen ELSE list_concat(seen, [digest, episode]) END, CASE WHEN hit THEN NULL ELSE o.doc_id END
  FROM r JOIN o ON o.k = r.k + 1, LATERAL (SELECT list_contains(r.seen, o.digest) OR list_contains(r.seen, o.episode) AS hit))
SELECT doc_id, episode, selected, CASE WHEN toxic = 1 THEN 'rejected' WHEN selected THEN 'high' WHEN toxic = 0 THEN 'usable' ELSE 'rejected' END AS quality_bucket,
       CASE WHEN ceil(size / 3.0) <= 500 THEN 'le_500' WHEN ceil(size / 3.0) <= 2000 THEN 'le_2000' ELSE 'over' END AS length_bucket,
       CASE WHEN selected AND coalesce(toxic, 0) <> 1 THEN 'train_candidate' ELSE 'audit_only' END AS action
FROM r JOIN o USING (doc_id)""")
def package_catalogue(spark, sf_dir):
    """Documents as traces, those of quality first; one row for each text and each episode (language, source and length), with its buckets and use."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    episode = F.concat_ws("-", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.floor(F.col("n_chars") / 20).cast("string"))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), episode.alias("episode"), F.octet_length(text).alias("size")).join(labels, "doc_id", "left")
    rows = rows.withColumn("selected", F.coalesce(F.col("quality") == 1, F.lit(False)))
    kept = catalogue.first_free(rows, [~F.col("selected"), F.col("doc_id")], [F.col("digest"), F.col("episode")])
    quality = F.when(F.col("toxic") == 1, "rejected").when(F.col("selected"), "high").when(F.col("toxic") == 0, "usable").otherwise("rejected")
    tokens = F.ceil(F.col("size") / 3)
    length = F.when(tokens <= 500, "le_500").when(tokens <= 2000, "le_2000").otherwise("over")
    action = F.when(F.col("selected") & (F.coalesce("toxic", F.lit(0)) != 1), "train_candidate").otherwise("audit_only")
    return kept.select("doc_id", "episode", "selected", quality.alias("quality_bucket"), length.alias("length_bucket"), action.alias("action"))


@query("""
WITH b AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 1.5 GROUP BY ALL),
j AS (SELECT coalesce(b.o_orderkey, r.o_orderkey) AS o_orderkey, b.n AS bn, r.n AS rn, b.suppliers AS bs, r.suppliers AS rs FROM b FULL JOIN r USING (o_orderkey))
SELECT o_orderkey, 'missing' AS change, NULL AS field, NULL AS expected, NULL AS found FROM j WHERE rn IS NULL
UNION ALL SELECT o_orderkey, 'changed', 'lines.n', bn::VARCHAR, rn::VARCHAR FROM j WHERE rn IS NOT NULL AND bn <> rn
UNION ALL SELECT o_orderkey, 'changed', 'lines.suppliers', bs::VARCHAR, rs::VARCHAR FROM j WHERE rn IS NOT NULL AND bs <> rs""")
def rebuilt_bundle(spark, sf_dir):
    """Orders with counts of their lines, against a rebuild that lost lines of one piece; both written as bundles and compared."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")

    def bundle(lines):
        held = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.struct(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers")).alias("lines"))
        return orders.select("o_orderkey", F.struct("o_orderpriority", "o_orderstatus", "o_totalprice").alias("order")).join(held, "o_orderkey")

    scratch = Scratch(spark, "bundles")
    paths = [scratch.path("expected"), scratch.path("found")]
    rebuild.write_bundle(bundle(lines), paths[0], "o_orderkey")
    rebuild.write_bundle(bundle(lines.where("l_quantity > 1.5")), paths[1], "o_orderkey")
    return rebuild.compare_bundles(spark, *paths, "o_orderkey")[1]
