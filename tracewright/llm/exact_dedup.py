"""Exact deduplication by an extendible-hash index kept on shared files; DataFrame functions only.

Texts are equal when identical after deleting ASCII white space. The index is built from the 64-bit hashes of the
texts: the directory starts as one bucket and is doubled, ``STEP`` times a round, while a bucket holds more than
``capacity`` hashes; a bucket splits only as deep as it must, and rounds go on, over the overfull buckets alone, until
none is left. What is shuffled for every text is its hash, id and length. A hash met once is an entry as it is; for hashes met
more than once the texts go to the owner of their bucket, copies collapsed inside each task, and the owner's
comparison of their bytes makes the entries: one for each different text, chained where such texts share a hash. The index is written in
ranges of (bucket, hash); every document finds its bucket by the leading bits of its hash, and its chain by the hash. Where the chain
has one entry, all texts of that hash have been compared already; in a longer one the document's bytes are compared with the entries'.

Defined results: a null text is empty; empty texts are equal to each other; rows that repeat an id share
its fate; of equally long texts one with a null id loses to any other; where such a row stays, all rows of its group
without an id count as kept; an empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.session import Scratch

WHITE = " \t\n\x0b\x0c\r"
LAST_ID = 9223372036854775807
STEP = 8


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def prefix(h: Column | str, depth: Column | int) -> Column:
    """The first ``depth`` bits of a hash, at the top of 64 with zeros below."""
    h, depth = F.col(h) if isinstance(h, str) else h, F.lit(depth) if isinstance(depth, int) else depth
    mask = F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - depth).cast("int")))
    return h.bitwiseAND(mask)


def kept_id(rank: str) -> Column:
    """The id in a rank; null for a row without one."""
    low = (F.lit(LAST_ID).cast("decimal(20,0)") - (F.col(rank) % F.lit("1" + "0" * 20).cast("decimal(21,0)"))).cast("long")
    return F.nullif(low, F.lit(LAST_ID))


def grow_directory(hashes: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """(bucket, depth): the buckets that distinct hashes ``h`` split into; a bucket is its hashes' common leading bits."""
    spark, leaves, depth = hashes.sparkSession, [], 0
    if hashes.count() <= capacity:
        return spark.range(1).select(F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth"))
    overfull = hashes
    while depth < 64:
        low, depth = depth, depth + STEP
        codes = scratch.save(overfull.groupBy(prefix("h", depth).alias("code")).agg(F.count("*").alias("n")), "codes")
        split = codes.select("code", "n", F.explode(F.sequence(F.lit(low + 1), F.lit(depth))).alias("depth")).withColumn("bucket", prefix("code", F.col("depth")))
        held = split.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
        fit = split.join(held, ["depth", "bucket"]).where((F.col("held") <= capacity) | (F.col("depth") == 64))
        leaf = fit.groupBy("code").agg(F.min("depth").alias("depth")).select(prefix("code", F.col("depth")).alias("bucket"), "depth").distinct()
        leaves.append(scratch.save(leaf, "leaves"))
        crowded = codes.where(F.col("n") > capacity).select("code")
        if depth == 64 or crowded.isEmpty():
            break
        overfull = overfull.join(crowded, prefix("h", depth) == F.col("code"), "left_semi")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def routed(rows: DataFrame, directory: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` with the bucket that their hash ``h`` leads to: one of the few depths in use has its prefix."""
    asked = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("bucket", prefix("h", F.col("depth")))
    return asked.join(directory, ["bucket", "depth"])


#: hashes met more than once are broadcast up to so many (8 bytes each); beyond, the join shuffles both sides
MOST_BROADCAST = 1 << 21


class Index:
    """The index over one input; see the module's docstring. ``bits`` of a hash are used (fewer in tests of chains)."""

    def __init__(self, docs: DataFrame, id: str, text: str, capacity: int, bits: int):
        self.scratch = Scratch(docs.sparkSession, "exact")
        whole = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), normalised(text).alias("norm"))
        # more code points first, then the smaller id, as one number whose maximum is wanted
        rank = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("decimal(38,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")
        rank = (rank + (F.lit(LAST_ID).cast("decimal(20,0)") - F.coalesce(F.col("id"), F.lit(LAST_ID)).cast("decimal(20,0)"))).cast("decimal(38,0)")
        self.texts = whole.select("id", rank.alias("rank"), "norm", prefix(F.xxhash64("norm"), bits).alias("h"))
        self.facts = self.scratch.save(self.texts.select("id", "rank", "h", F.unhex(F.sha2("norm", 256)).alias("mark")), "facts")
        hashes = self.scratch.save(self.facts.groupBy("h").agg(F.count("*").alias("n"), F.max("rank").alias("rank")), "hashes")
        self.directory = self.scratch.save(grow_directory(hashes.select("h"), self.scratch, capacity), "directory")
        self.depths = sorted(r["depth"] for r in self.directory.select("depth").distinct().collect())  # at most 65
        self.repeated = hashes.where("n > 1").select("h")
        # owners compare the bytes of what goes to their buckets
        sent = routed(self.of(self.texts.select("h", "norm", "rank"), self.repeated), self.directory, self.depths)
        owned = sent.groupBy("bucket", "h", "norm").agg(F.count("*").alias("group_size"), F.max("rank").alias("rank"))
        self.owned = self.scratch.save(owned.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("mark"), kept_id("rank").alias("keep_id"), "group_size"), "owned")
        chains = self.owned.groupBy("bucket", "h").agg(F.sort_array(F.collect_list(F.struct("mark", "keep_id", "group_size"))).alias("chain"))
        lone = hashes.where("n = 1").select("h", F.struct(F.lit(None).cast("binary").alias("mark"), kept_id("rank").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).alias("entry"))
        lone = routed(lone, self.directory, self.depths).select("bucket", "h", F.array("entry").alias("chain"))
        self.index = self.scratch.save(chains.unionByName(lone).repartitionByRange("bucket", "h"), "index")

    def of(self, rows: DataFrame, hashes: DataFrame) -> DataFrame:
        """The rows that have one of some different hashes, which are broadcast if they are few."""
        few = hashes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        return rows.join(F.broadcast(hashes) if few else hashes, "h", "left_semi")

    def look_up(self) -> DataFrame:
        """(id, keep_id, group_size, mark) of every document, from its chain."""
        asked = routed(self.facts.select("id", "h", "mark"), self.directory, self.depths)
        found = asked.join(self.index, ["bucket", "h"]).where("size(chain) = 1").withColumn("entry", F.element_at("chain", 1))
        found = found.select("id", "entry.keep_id", "entry.group_size", asked["mark"])
        # documents whose hash is shared by different texts: their bytes against those of the chain's texts
        longer = self.index.where("size(chain) > 1").select("h", F.explode("chain").alias("entry"))
        if longer.isEmpty():
            return found
        held = self.of(self.texts, longer.select("h").distinct())
        texts = held.groupBy("h", "norm").agg(F.unhex(F.sha2("norm", 256)).alias("mark"))
        chained = longer.select("h", "entry.*").join(texts, ["h", "mark"])
        asked = held.select("id", F.col("h").alias("k"), F.col("norm").alias("own"))
        return found.unionByName(asked.join(chained, (F.col("k") == F.col("h")) & (F.col("own") == F.col("norm"))).select(*found.columns))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 4096, bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    """
    found = Index(docs, id, text, capacity, bits).look_up()
    return found.select(F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("mark")).alias("text_sha256"))
