"""Structured Streaming over event files: windows, sessions, deduplication, resumable ledgers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.session import Scratch


def read_events(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 100) -> DataFrame:
    """A stream over immutable Parquet files; ``ts`` becomes a timestamp, as watermarks need."""
    schema = schema or spark.read.parquet(path).schema
    if path.endswith(".parquet"):  # a stream takes a folder or a pattern, and one file matches itself
        path = path[:-1] + "[" + path[-1] + "]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, size: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums by window and keys; rows later than ``late`` behind the newest are left out."""
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *keys)
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(rows: DataFrame, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), *keys)
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key: a window ends ``gap`` after its last event."""
    out = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return out.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Each key once within the watermark; without one, over all that came, with every key kept as state."""
    return rows.dropDuplicates(keys) if late is None else rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def after(rows: DataFrame, sequence: str, last: int) -> DataFrame:
    """What follows a sequence number already handled."""
    return rows.where(F.col(sequence) > last)


def drain(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read it.

    Append mode goes to a Parquet sink with its own checkpoint, so a restart neither loses nor repeats rows; complete mode
    rewrites one table for each batch, and the last one is the result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, name)
    out, mark = scratch.path("rows"), scratch.path("checkpoint")
    if mode == "append":
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append")
    else:
        query = rows.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", mark).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def each_batch(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every batch to an idempotent sink; the checkpoint remembers which were done."""
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
