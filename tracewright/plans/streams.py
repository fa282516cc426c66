"""Streaming queries over the event table, each with the same rows as a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.plans.registry import load, query
from tracewright.session import Scratch
from tracewright.sources import tail
from tracewright.streaming import events, recovery


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streaming_tumbling(spark, sf_dir):
    """Daily windows in complete mode, so that the last windows are there too."""
    out = events.drain(events.tumbling(events.read_events(spark, f"{sf_dir}/events.parquet"), "1 day", "1 hour", "event_type"), "tumbling", "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY 1, 2")
def streaming_dedupe(spark, sf_dir):
    """Each event once, appended to a durable table."""
    out = events.drain(events.once(events.read_events(spark, f"{sf_dir}/events.parquet"), ["event_id"]), "dedupe")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events WHERE event_id > 100 GROUP BY 1")
def streaming_resume(spark, sf_dir):
    """Only what follows the sequence number handled last."""
    out = events.drain(events.after(events.read_events(spark, f"{sf_dir}/events.parquet"), "event_id", 100), "resume")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""
WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events))
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    """Extension: sessions that end six hours after their last event."""
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("""
SELECT epoch(date_trunc('hour', ts) - i * INTERVAL 1 HOUR)::BIGINT AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events, range(3) r(i) GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    """Extension: three-hour windows every hour."""
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "n", "total")


@query("""
SELECT user_id, epoch_us(max(ts)) AS last_us, (SELECT max(ts) FROM events) - max(ts) > INTERVAL 1 DAY AS stale FROM events GROUP BY 1""")
def staleness_alert(spark, sf_dir):
    """Keys without an update for a day."""
    rows = load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    newest = rows.agg(F.max("us").alias("newest"))
    out = rows.groupBy("user_id").agg(F.max("us").alias("last_us")).crossJoin(F.broadcast(newest))  # one row
    return out.select("user_id", "last_us", (F.col("newest") - F.col("last_us") > 86_400_000_000).alias("stale"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def tailed_events(spark, sf_dir):
    """Events written as lines to a shared folder and tailed from there by byte offsets, twice: the second run finds nothing to repeat."""
    scratch = Scratch(spark, "tailed")
    lines, out, mark = scratch.path("lines"), scratch.path("rows"), scratch.path("checkpoint")
    load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value")).write.text(lines)
    rows = tail.tail(spark, f"{lines}/part-*")
    parsed = rows.select(F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("e")).select("e.*")
    for _ in range(2):
        parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parsed.schema).parquet(out)


@query("""SELECT user_id::VARCHAR || ':' || event_type AS key, max(floor(value)::BIGINT) AS attempt, max_by(event_id, (floor(value)::BIGINT, event_id)) AS at, max_by(coalesce(props, ''), (floor(value)::BIGINT, event_id)) AS value
FROM events WHERE value IS NOT NULL GROUP BY 1""")
def recovery_items(spark, sf_dir):
    """The newest attempt (by the value's floor, then the event) of each user and event type, kept as state and told as an index table."""
    scratch = Scratch(spark, "recovery")
    table, mark = scratch.path("index"), scratch.path("checkpoint")
    rows = events.read_events(spark, f"{sf_dir}/events.parquet")
    key = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    items = rows.select(key.alias("key"), F.floor("value").alias("attempt"), F.col("event_id").alias("at"), F.coalesce("props", F.lit("")).alias("value"))
    recovery.materialised(recovery.recovery_index(items), table, mark)
    return recovery.index(spark, table)
