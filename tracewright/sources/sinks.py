"""Sinks: routed and partitioned tables with manifests, content-addressed blobs, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.operators.checks import ExpectationError


def jsonl(df: DataFrame, path: str) -> None:
    """Gzip-compressed JSON lines with keys in alphabetical order; the target must be new."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def routed(df: DataFrame, path: str, route: str) -> DataFrame:
    """One pass into a folder for each route, and the manifest: (route, rows)."""
    df.write.mode("errorifexists").partitionBy(route).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(route).agg(F.count("*").alias("rows"))


def with_manifest(df: DataFrame, path: str, split: str, key: str) -> DataFrame:
    """Partitions by split, and (split, rows, digest): the digest is of the rows' keys, whatever their order."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)
    written = df.sparkSession.read.parquet(path)
    part = F.conv(F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return written.groupBy(split).agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("digest"))


def put_blobs(df: DataFrame, content: str, path: str) -> DataFrame:
    """Append blobs that are not stored yet, by digest; (sha256, byte_count) of all rows given."""
    spark = df.sparkSession
    rows = df.select(F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("byte_count"), F.col(content).alias("content"))
    fresh = rows.dropDuplicates(["sha256"])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    fresh.write.mode("append").parquet(path)
    return rows.drop("content")


def get_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(sha256, content) of wanted digests; content that is missing or does not match its digest is an error."""
    found = wanted.select("sha256").distinct().join(spark.read.parquet(path).select("sha256", "content"), "sha256", "left")
    if bad := found.where((F.col("content").isNull()) | (F.sha2("content", 256) != F.col("sha256"))).select("sha256").limit(3).collect():
        raise ExpectationError(f"blobs missing or damaged: {[r['sha256'] for r in bad]}")
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row with a Markdown table; for reports of a bounded number of rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))
