"""A recovery index kept as keyed state: the newest attempt of each request, until its time to live is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "attempt long, at long, value string"
TOLD = "key string, attempt long, at long, value string"


class NewestAttempt(StatefulProcessor):
    """Keeps of each key the item of the greatest attempt, of one attempt the last in order, and tells it when it changes."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        best = tuple(old) if old is not None else None
        for frame in rows:
            for row in frame[["attempt", "at", "value"]].itertuples(index=False, name=None):
                if best is None or row[:2] >= best[:2]:
                    best = (int(row[0]), int(row[1]), row[2])
        if best is not None and (old is None or best != tuple(old)):
            self.held.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=["key", "attempt", "at", "value"])

    def close(self) -> None:
        pass


def recovery_index(items: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (key, attempt, at, value): what stands for a key whenever that may have changed.

    items is a stream of (key, attempt, at, value), ``at`` telling the order within an attempt; items without key or attempt are left out. The
    state of a key is one item. With ``ttl_ms`` it goes that long after its last change, by a state of our own; without, keys are
    aggregated, which costs no call of Python for each of them. An older attempt that comes late changes nothing while the newer one is held.
    """
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = items.where("key is not null and key <> '' and attempt is not null").select("key", F.col("attempt").cast("long").alias("attempt"), F.col("at").cast("long").alias("at"), "value")
    if ttl_ms:
        return known.groupBy("key").transformWithStateInPandas(NewestAttempt(ttl_ms), TOLD, outputMode="Update", timeMode="ProcessingTime")
    return known.groupBy("key").agg(F.max(F.struct("attempt", "at", "value")).alias("held")).select("key", "held.*")


def materialised(updates: DataFrame, table: str, checkpoint: str) -> None:
    """Brings the index table up to date with what has come: every batch is a folder of its own, written again if it is repeated."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/batch={number:08d}")

    updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index(spark, table: str) -> DataFrame:
    """(key, attempt, at, value): the last that was told of each key."""
    told = spark.read.option("recursiveFileLookup", "true").schema(TOLD + ", batch long").parquet(table)
    return told.groupBy("key").agg(F.max_by(F.struct("attempt", "at", "value"), "batch").alias("held")).select("key", "held.*")
