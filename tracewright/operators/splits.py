"""Group-safe splits over connected components, leakage audits, decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.operators.graph import components


def grouped_by_keys(rows: DataFrame, id: str, keys: list[str]) -> DataFrame:
    """(id, component): rows that share a value of any key, directly or through others, are one group.

    Each key value is tied to its smallest id, so a value shared by n rows makes n edges, not n * n.
    """
    edges = None
    for key in keys:
        low = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id).alias("least"))
        tie = rows.join(low, key).select(F.col(id).alias("a"), F.col("least").alias("b"))
        edges = tie if edges is None else edges.unionByName(tie)
    found = components(edges)
    return rows.select(F.col(id).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def excluded_groups(rows: DataFrame, group: str, bad: str) -> DataFrame:
    """``rows`` without every group that holds a bad row; counted by group first, so large groups do not gather."""
    spoiled = rows.where(F.col(bad)).select(group).distinct()
    return rows.join(spoiled, group, "left_anti")


def holding_passages(docs: DataFrame, id: str, text: str, passages: DataFrame, passage_id: str, passage: str, k: int = 8) -> DataFrame:
    """(id, passage_id) of documents that hold a whole passage.

    Passages are found by their first k words: an equi-join of the hashes of documents' word k-grams to those of the
    passages, then an exact containment check of the normalised texts. Passages of fewer than k words are looked up by all
    their words.
    """
    from tracewright.functions.text import normalise

    clean = passages.select(F.col(passage_id).alias("passage_id"), normalise(F.col(passage)).alias("wanted")).where("wanted <> ''")
    words = F.split("wanted", " ")
    clean = clean.withColumn("size", F.least(F.size(words), F.lit(k))).withColumn("gram", F.xxhash64(F.slice(words, F.lit(1), F.col("size"))))
    sizes = [r["size"] for r in clean.select("size").distinct().collect()]  # at most k numbers
    rows = docs.select(F.col(id).alias("id"), normalise(F.col(text)).alias("body")).withColumn("w", F.split("body", " "))
    grams = None
    for size in sizes:
        at = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.slice("w", i, F.lit(size))))))
        part = rows.where(F.size("w") >= size).select("id", at.alias("gram"))
        grams = part if grams is None else grams.unionByName(part)
    if grams is None:
        return docs.select(F.col(id), F.lit(None).cast("long").alias(passage_id)).limit(0)
    found = grams.join(clean, "gram").select("id", "passage_id", "wanted").distinct().join(rows.select("id", "body"), "id")
    held = found.where(F.contains(F.concat(F.lit(" "), F.col("body"), F.lit(" ")), F.concat(F.lit(" "), F.col("wanted"), F.lit(" "))))
    return held.select(F.col("id").alias(id), F.col("passage_id").alias(passage_id)).distinct()
