"""The corpus pipeline: toxicity, exact, MinHash and substring deduplication, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs.
All but the last return the columns of documents, and drop or change only what their operator decides:

* toxicity drops the documents that score 0.5 or more;
* exact_dedup keeps one row of each group of equal texts;
* minhash_dedup keeps the smallest id of each component of near-duplicates;
* substring_dedup cuts repeated passages of 50 words or more out of later documents, and drops a document that loses
  all its words (one that had none stays);
* packing returns a row for each piece with its place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm import exact_dedup as exact, minhash, packing, substring, toxicity as toxic
from tracewright.llm.queries import tokenizer_path
from tracewright.session import Scratch, ship


def kept_by(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has a verdict that keeps it; ``verdict`` is (doc_id, kept).

    Rows that share an id share its fate.
    """
    ids = verdict.where("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxic.toxicity(docs.select("doc_id", "text"), labels)
    return kept_by(docs, scored.select("doc_id", (F.col("predicted") == 0).alias("kept")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_by(docs, exact.exact_dedup(docs.select("doc_id", "text")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return kept_by(docs, minhash.minhash_dedup(docs.select("doc_id", "text")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
