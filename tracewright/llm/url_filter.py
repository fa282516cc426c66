"""URL lists in time: every capture against the list entries active when it was fetched; DataFrame functions only.

An entry says from when a host is listed under an action, and is valid until the host's next entry. A capture is looked up
under its host and every parent domain of it, by an as-of join on (name, time): the entry in force is the name's last one at or before
the fetch. Both sides are range-partitioned by name and time, so that an entry is one row however long it is valid, and a host
with most captures or entries is many tasks. The entry of the longest name in force decides. Entries of one host at one
time: the greatest ``entry_id`` counts.

Defined results: a capture with a null or hostless url, or without a fetch time, has no entry and is allowed; repeated captures
each have a row; entries with a null host or time are ignored, and so are further columns, whatever their names; hosts are
compared in lower case without port or user; empty tables give no rows, or captures without entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.operators.checks import asof_join


def host_of(url: Column) -> Column:
    place = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")


def filter_urls(captures: DataFrame, entries: DataFrame, id: str, url: str, fetched: str) -> DataFrame:
    """(id, host, fetched_at, entry_id, listed_host, action, allowed) for every row of ``captures``; entries are (entry_id, host, at, action)."""
    rows = captures.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), F.col(fetched).alias("t"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    names = F.when((F.col("host") != "") & F.col("t").isNotNull(), parents).otherwise(F.array(F.lit("")))
    asked = rows.withColumn("listed", F.explode(names))
    known = entries.where("host is not null and at is not null").select(F.lower("host").alias("listed"), F.col("at").alias("since"), "entry_id", "action")
    found = asof_join(asked, known.where("listed <> ''"), ["listed"], "t", "since", ["entry_id", "action"])
    best = F.max(F.when(F.col("since").isNotNull(), F.struct(F.length("listed").alias("size"), "listed", "entry_id", "action")))
    # a capture has one row under its first name, which counts its copies
    first = F.col("listed").isin("") | (F.col("listed") == F.col("host"))
    told = found.groupBy("id", "host", "t").agg(best.alias("best"), F.count_if(first).alias("copies"))
    told = told.select("id", "host", "t", "best", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    action = F.col("best.action")
    columns = [F.col("best.entry_id").alias("entry_id"), F.col("best.listed").alias("listed_host"), action.alias("action")]
    return told.select(F.col("id").alias(id), "host", F.col("t").alias("fetched_at"), *columns, F.coalesce(action != "block", F.lit(True)).alias("allowed"))
