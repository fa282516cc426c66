"""Queries over the given tables, one for each operator of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.registry import load, query


@query("""
WITH s AS (
  SELECT quality AS gold, CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS pred
  FROM labels JOIN documents USING (doc_id))
SELECT CASE WHEN gold IS NULL THEN 'all' ELSE CAST(gold AS VARCHAR) END AS gold_class,
       count(*) AS support,
       count(*) FILTER (WHERE pred = 0) AS pred_0,
       count(*) FILTER (WHERE pred = 1) AS pred_1,
       round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM s GROUP BY GROUPING SETS ((), (gold))
""")
def confusion_balanced_accuracy(spark, sf_dir):
    """Zero-filled confusion counts and recall of each class, with the overall row."""
    gold = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold"))
    rule = load(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 2000).cast("int").alias("pred"))
    scored = gold.join(rule, "doc_id")
    return (
        scored.groupingSets([[], [F.col("gold")]], F.col("gold"))
        .agg(
            F.count("*").alias("support"),
            F.count_if(F.col("pred") == 0).alias("pred_0"),
            F.count_if(F.col("pred") == 1).alias("pred_1"),
            F.round(F.avg((F.col("pred") == F.col("gold")).cast("double")), 6).alias("accuracy"),
        )
        .select(F.coalesce(F.col("gold").cast("string"), F.lit("all")).alias("gold_class"), "support", "pred_0", "pred_1", "accuracy")
    )
