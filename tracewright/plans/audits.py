"""Audit, routing and ledger queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tracewright.functions import nested, text, urls
from tracewright.operators import passages, select
from tracewright.plans.registry import load, query


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 0 DESC, abs(s_acctbal), s_suppkey) = 1")
def checkpoint_choice(spark, sf_dir):
    """The best by several criteria, each with its own direction."""
    rows = load(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return select.best_per_key(rows, ["s_nationkey"], [-(F.col("s_acctbal") > 0).cast("int"), F.abs("s_acctbal"), F.col("s_suppkey")])


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def leaderboard(spark, sf_dir):
    """Groups ranked by their result; one row for each of a bounded number of groups reaches the last window."""
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    rows = load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    totals = rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals.withColumn("place", F.rank().over(Window.orderBy(F.desc("total"))))


@query("""
SELECT source, count(*) FILTER (WHERE quality = 1) AS n_reference, coalesce(round(count(*) FILTER (WHERE quality = 1 AND n_chars >= 2000) / nullif(count(*) FILTER (WHERE quality = 1), 0), 6), 1.0) AS recall,
       coalesce(round(count(*) FILTER (WHERE quality = 1 AND n_chars >= 2000) / nullif(count(*) FILTER (WHERE n_chars >= 2000), 0), 6), CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 1.0 ELSE 0.0 END) AS precision
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def fact_recall_precision(spark, sf_dir):
    """Recall and precision with their conventions for empty denominators."""
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    ref, got = F.col("quality") == 1, F.col("n_chars") >= 2000
    counts = rows.groupBy("source").agg(F.count_if(ref).alias("r"), F.count_if(got).alias("g"), F.count_if(ref & got).alias("b"))
    empty = F.when(F.col("r") == 0, 1.0).otherwise(0.0)
    return counts.select(
        "source", F.col("r").alias("n_reference"), F.coalesce(F.round(F.try_divide("b", "r"), 6), F.lit(1.0)).alias("recall"), F.coalesce(F.round(F.try_divide("b", "g"), 6), empty).alias("precision")
    )


@query("""
WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS comparable, round(count(*) FILTER (WHERE value > 10) / count(*), 6) AS rate FROM l GROUP BY 1""")
def latest_record_summary(spark, sf_dir):
    """Conditional aggregates over the latest record of each id."""
    last = select.best_per_key(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], [-F.col("event_id")])
    good = F.count_if(F.col("value") > 10)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), good.alias("comparable"), F.round(good / F.count("*"), 6).alias("rate"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'error') AS misses,
       round(count(*) FILTER (WHERE event_type = 'view') / nullif(count(*) FILTER (WHERE event_type IN ('view', 'error')), 0), 6) AS hit_ratio FROM events GROUP BY 1""")
def cache_metrics(spark, sf_dir):
    """Counters of many workers and their ratio."""
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "error")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(F.try_divide(hits, hits + misses), 6).alias("hit_ratio"))


@query("""
WITH c AS (SELECT user_id, event_id, sum(value) OVER w AS total, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, round(max(total) FILTER (WHERE i = n) - max(total) FILTER (WHERE i = n - 3), 4) AS gained, round(max(total) FILTER (WHERE i = n), 4) AS total FROM c GROUP BY 1""")
def counter_delta(spark, sf_dir):
    """A32, and of A27 the difference: what a cumulative counter gained over the last three rows."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = load(spark, sf_dir, "events").withColumn("total", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("gained", F.col("total") - F.lag("total", 3).over(w))
    return rows.groupBy("user_id").agg(F.round(F.max_by("gained", "event_id"), 4).alias("gained"), F.round(F.max_by("total", "event_id"), 4).alias("total"))


@query("""
WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS k FROM part)
SELECT CASE WHEN (k // 8) % 2 = 0 THEN k % 8 ELSE 7 - k % 8 END AS shard, count(*) AS n, sum(p_size)::BIGINT AS load FROM r GROUP BY 1""")
def least_loaded_shards(spark, sf_dir):
    """P7 by another rule: work dealt to shards there and back in order of size, which keeps their loads close."""
    ranked = select.global_rank(load(spark, sf_dir, "part").select("p_partkey", "p_size").withColumn("k", F.struct(-F.col("p_size"), F.col("p_partkey"))), "k")
    turn = F.pmod("rank", F.lit(8))
    shard = F.when(F.pmod(F.floor(F.col("rank") / 8), F.lit(2)) == 0, turn).otherwise(7 - turn)
    return ranked.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.sum("p_size").alias("load"))


@query(r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, host, regexp_matches(host, '(^|\.)example\.(net|com)$') AS blocked FROM h""")
def deny_list(spark, sf_dir):
    """P18 without titles and snippets: hosts under a denied domain."""
    host = urls.host(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", host.alias("host"), urls.under(host, ["example.net", "example.com"]).alias("blocked"))


@query(r"""
SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|pdf|mp4)(\?|#|$)') AND NOT contains(lower(url), 'blog.') AS preferred FROM pages""")
def preferred_urls(spark, sf_dir):
    """Candidate URLs by scheme, host and media suffix."""
    u = F.col("url")
    ok = u.rlike("^https?://[^/?#]+") & ~F.lower(u).rlike(r"\.(jpg|jpeg|png|gif|pdf|mp4)(\?|#|$)") & ~F.contains(F.lower(u), F.lit("blog."))
    return load(spark, sf_dir, "pages").select("page_id", ok.alias("preferred"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, ['qty:' || CASE WHEN l_quantity > 45 THEN 'fatal' ELSE 'warn' END, 'tax:' || CASE WHEN l_tax > 0.06 THEN 'fatal' ELSE 'note' END] AS codes FROM lineitem)
SELECT l_orderkey, l_linenumber, list_filter(codes, lambda x: contains(x, 'fatal')) AS fatal, list_filter(codes, lambda x: NOT contains(x, 'fatal')) AS warnings FROM c""")
def fatal_and_warning_codes(spark, sf_dir):
    """P16, and of D14 the codes: codes parted by markers."""
    codes = F.array(F.concat(F.lit("qty:"), F.when(F.col("l_quantity") > 45, "fatal").otherwise("warn")), F.concat(F.lit("tax:"), F.when(F.col("l_tax") > 0.06, "fatal").otherwise("note")))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codes.alias("codes"))
    is_fatal = lambda x: F.contains(x, F.lit("fatal"))
    return rows.select("l_orderkey", "l_linenumber", F.filter("codes", is_fatal).alias("fatal"), F.filter("codes", lambda x: ~is_fatal(x)).alias("warnings"))


@query("SELECT event_id, key, CAST(value AS VARCHAR) AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events)")
def nested_values(spark, sf_dir):
    """The leaves of nested values."""
    rows = load(spark, sf_dir, "events").select("event_id", F.explode(nested.walk(F.col("props"))).alias("leaf"))
    return rows.select("event_id", "leaf.key", "leaf.value")


@query("""
SELECT event_id, list_sort(list_transform(list_filter(coalesce(json_keys(props), []), lambda k: lower(k) IN ('gold', 'private', 'k')), lambda k: '$.' || k)) AS paths FROM events""")
def private_field_scan(spark, sf_dir):
    """Forbidden keys at any depth of each event's own properties, as paths; none for what is not JSON."""
    return load(spark, sf_dir, "events").select("event_id", nested.private_paths(F.col("props"), ["gold", "private", "k"]).alias("paths"))


@query("SELECT sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents")
def passage_lengths(spark, sf_dir):
    """Characters of all texts as passages and the gaps between them; the sum is the texts' length whatever the spans are, passage_spans gives them (D3)."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("size"), passages.passages(F.col("text")).alias("p"))
    held = F.aggregate("p", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    gaps = F.aggregate("p", F.struct(F.lit(0).alias("last"), F.lit(0).alias("gap")), lambda a, x: F.struct(x["end"].alias("last"), (a["gap"] + x["start"] - a["last"]).alias("gap")), lambda a: a["gap"] + F.col("size") - a["last"])
    return rows.select((held + gaps).alias("chars")).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))


@query()
def passage_spans(spark, sf_dir):
    """D3: a row for each passage of each text, with its exact offsets."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(passages.passages(F.col("text"))).alias("p"))
    return rows.select("doc_id", "p.start", "p.end")


@query()
def semantic_near_duplicates(spark, sf_dir):
    """Turns of a conversation that repeat an accepted one, in order."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.query_tokens(F.col("text")).alias("tokens"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "tokens"))).alias("t"))
    sets = F.transform("t", lambda x: x["tokens"])
    return ordered.select("conv_id", F.size("t").alias("turns"), (F.size("t") - F.size(passages.accepted(sets, 0.8))).alias("repeated"))


@query()
def passages_within_budget(spark, sf_dir):
    """The turns of a conversation, best score first, that fit a budget of characters."""
    score = text.goal_score(F.col("text"), F.lit("the and of"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.char_length("text").cast("long").alias("size"), score.alias("score"))
    items = F.collect_list(F.struct("score", "place", "size"))
    return rows.groupBy("conv_id").agg(items.alias("items")).select("conv_id", passages.within_budget(F.col("items"), 800).alias("turns"))


@query()
def fuzzy_fact_match(spark, sf_dir):
    """The user turns of a conversation matched one to one with its assistant turns."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", text.fact_tokens(F.col("text")).alias("tokens"), "role")
    part = lambda role: turns.where(F.col("role") == role).select("conv_id", "turn", "tokens")
    return passages.greedy_match(part("user"), part("assistant"), "conv_id", 0.05)
