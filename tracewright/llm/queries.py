"""The registered query of each training-corpus operator, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from tracewright.llm import embeddings, exact_dedup as exact, filter_audit, fim, minhash, packing, sampling, sharding, substring, suffixes, toxicity as toxic, url_filter, warc


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxic.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(32)], 3203


def op2_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


OP2_SQL = f"""
WITH RECURSIVE s AS (
  SELECT list(('0x' || substr(md5(n), 1, 8))::BIGINT % {SLOTS} ORDER BY i) AS at,
         list(('0x' || substr(md5(n), 9, 8))::BIGINT % ({SLOTS} - 1) + 1 ORDER BY i) AS skip
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS n FROM range({len(SHARDS)}) r(i))),
fill AS (
  SELECT 0 AS turn, list_resize([]::INT[], {SLOTS}, -1) AS owners, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_transform(owners, lambda o, k: CASE WHEN k = pick + 1 THEN turn % {len(SHARDS)} ELSE o END)::INT[], pick
  FROM (SELECT f.turn, f.owners,
               list_filter(list_transform(range({SLOTS}), lambda j: (s.at[f.turn % {len(SHARDS)} + 1] + j * s.skip[f.turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda p: f.owners[p + 1] = -1)[1] AS pick
        FROM fill f, s WHERE f.turn < {SLOTS}) x),
t AS (SELECT slot, (turn - 1) % {len(SHARDS)} AS shard FROM fill WHERE turn > 0)
SELECT doc_id, slot::INT AS slot, shard::INT AS shard, 'shard-' || lpad(shard::VARCHAR, 2, '0') AS shard_name
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents) d JOIN t USING (slot)
"""


def op3_warc_transactions(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_minhash_near_dedup(spark, sf_dir):
    return minhash.minhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_sentencepiece_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


def op7_embedding_near_dedup(spark, sf_dir):
    return embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark, sf_dir):
    """Pages fetched through January 2024 against a list of one entry for each event: error and click block, others allow.

    An event's entry names one of the pages' hosts or of their last two labels, by the md5 of its id.
    """
    from pyspark.sql import functions as F

    from tracewright.operators.select import global_rank

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(43_200))
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.unionByName(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host"))).where("host <> ''").distinct()
    names = global_rank(names, "host")
    place = F.pmod(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(max(1, names.count())))
    action = F.when(F.col("event_type").isin("error", "click"), "block").otherwise("allow")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), place.alias("rank"))
    out = url_filter.filter_urls(captures, events.join(names, "rank").drop("rank"), "page_id", "url", "fetched_at")
    return out.withColumn("fetched_at", F.unix_seconds("fetched_at"))


OP10_SQL = r"""
WITH c AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host,
         1704067200 + ((page_id * 7919) % 43200) * 60 AS t FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
n AS (
  SELECT host, row_number() OVER (ORDER BY host) - 1 AS k, count(*) OVER () AS total
  FROM (SELECT host FROM h UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM h) WHERE host <> ''),
e AS (
  SELECT n.host, epoch_us(v.ts) AS since, max_by(CASE WHEN event_type IN ('error', 'click') THEN 'block' ELSE 'allow' END, event_id) AS action, max(event_id) AS entry_id
  FROM events v JOIN n ON n.k = ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % n.total GROUP BY 1, 2),
i AS (SELECT *, lead(since) OVER (PARTITION BY host ORDER BY since) AS until FROM e),
f AS (
  SELECT c.page_id, c.host, c.t, i.host AS listed, i.entry_id, i.action,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.host) DESC) AS k
  FROM c JOIN i ON (c.host = i.host OR suffix(c.host, '.' || i.host)) AND i.since <= c.t * 1000000 AND (i.until IS NULL OR c.t * 1000000 < i.until))
SELECT c.page_id, c.host, c.t AS fetched_at, f.entry_id, f.listed AS listed_host, f.action, coalesce(f.action <> 'block', true) AS allowed
FROM c LEFT JOIN f ON f.page_id = c.page_id AND f.k = 1
"""


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * coalesce(list_unique(w), 0) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, f AS filter, b AS bit,
         (SELECT coalesce(sum(x.b), 0) FROM f x WHERE strpos(filter_order, x.f) < step)::INT AS before
  FROM o, range(1, 6) r(step), f WHERE f.f = substr(filter_order, step::INT, 1)),
t AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM t
"""


def op12_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM d),
c AS (
  SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(l) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(l) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, n, form, t, array_to_string(l[1:least(a, b)], '') AS pre, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(l[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def op13_suffix_array_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    out = suffixes.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op6_sentencepiece_sampling": op6_sentencepiece_sampling, "op2_sharding": op2_sharding, "op10_url_filter": op10_url_filter, "op7_embedding_near_dedup": op7_embedding_near_dedup, "op1_best_fit_packing": op1_best_fit_packing, "op3_warc_transactions": op3_warc_transactions, "op4_substring_dedup": op4_substring_dedup, "op9_minhash_near_dedup": op9_minhash_near_dedup, "op5_exact_dedup": op5_exact_dedup, "op8_toxicity": op8_toxicity, "op11_filter_audit": op11_filter_audit, "op12_fill_in_middle": op12_fill_in_middle, "op13_suffix_array_dedup": op13_suffix_array_dedup}
# SHA-1 is not among DuckDB's functions, so op3 has brute-force tests instead
ORACLES = {"op2_sharding": OP2_SQL, "op10_url_filter": OP10_SQL, "op5_exact_dedup": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
