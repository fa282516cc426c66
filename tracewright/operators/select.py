"""Selection: best of N, first and last per key, quotas, splits, shards, rollout grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.hashing import seeded_hex, u31, uniform
from tracewright.session import Scratch


def best_per_key(rows: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """The row of each key with the least rank, compared part by part; end ``rank`` with the row's id."""
    packed = F.struct("*")
    best = rows.groupBy(*key).agg(F.min_by(packed, F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)))).alias("row"))
    return best.select("row.*")


def losers(rows: DataFrame, key: list[str], rank: list[Column], reason: str) -> DataFrame:
    """All rows but the best of each key, with the reason they were left out."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*rank))
    return rows.withColumn("_place", place).where("_place > 1").drop("_place").withColumn("reason", F.lit(reason))


def retry_merge(attempts: DataFrame, key: list[str], order: str, failed: Column) -> DataFrame:
    """The row that stands for each key: the first that did not fail, else the last; with the attempts made."""
    rows = attempts.withColumn("_failed", failed)
    packed = F.struct(*attempts.columns)
    out = rows.groupBy(*key).agg(
        F.min_by(F.when(~F.col("_failed"), packed), F.when(~F.col("_failed"), F.col(order))).alias("good"),
        F.max_by(packed, F.col(order)).alias("last"),
        F.count("*").alias("attempts"),
        F.count_if("_failed").alias("failures"),
    )
    return out.withColumn("row", F.coalesce("good", "last")).select("row.*", "attempts", "failures")


def by_list(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of an explicit list of ids, with their place in it (from 0); a missing id is an error."""
    listed = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, wanted))).alias("position", key))
    found = F.broadcast(listed).join(rows, key, "left")
    known = rows.select(F.col(key).alias("_known")).distinct()
    missing = listed.join(known, listed[key] == known["_known"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"ids not found: {[r[key] for r in missing]}")
    return found


def modulo_shard(rows: DataFrame, key: str, shards: int, index: int) -> DataFrame:
    """Rows whose rank by id, counted from 0, is ``index`` modulo ``shards``.

    Ranks are counted in range partitions, then shifted by the rows before each; no task sees all rows.
    """
    ranked = global_rank(rows, key)
    return ranked.where(F.pmod(F.col("rank"), F.lit(shards)) == index)


def global_rank(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with their rank by a unique id, from 0: ranks within range partitions plus the rows before them.

    The range-partitioned rows are written once with the number of their partition, so that the ranks and the counts
    before them speak of the same partitions however each reader's shuffles are coalesced. The write is a job of its own.
    """
    spread = rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    spread = Scratch(rows.sparkSession, "rank").save(spread, "ranges")
    local = spread.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"), F.min(key).alias("_low"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_low")) - F.col("n")).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("rank", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def hash_sample(rows: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """n rows in the order of sha256(salt:id)."""
    return rows.withColumn("order_key", seeded_hex(salt, key)).orderBy("order_key").limit(n)


def stratum_quota(rows: DataFrame, key: str, strata: list[str], seed: str, quota: int | Column) -> DataFrame:
    """Up to ``quota`` rows of each stratum, in hash order."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(seeded_hex(seed, key), key))
    return rows.withColumn("place", place).where(F.col("place") <= quota)


def alternating(rows: DataFrame, key: str, label: str, seed: str, n: int) -> DataFrame:
    """n rows that take turns between the classes, each in hash order; no class gives more than its first n.

    The bound on the place lets every task keep n rows of a class before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(label).orderBy(seeded_hex(seed, key, "\x00"), key))
    return rows.withColumn("turn", place).where(F.col("turn") <= n).orderBy("turn", label).limit(n)


def ratio_split(rows: DataFrame, group: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """A split for each row by the uniform hash of its group; rows of a group stay together."""
    u, upto, out = uniform(seeded_hex(seed, group)), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return rows.withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1]))


def rollout_grid(cases: DataFrame, case: str, n: int, seed: str) -> DataFrame:
    """(case, rollout_index, prompt_group_id, sampling_seed, episode_id), n for each case."""
    grid = cases.select(case, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rollout_index"))
    text = F.concat_ws(":", F.lit(seed), F.col(case).cast("string"), F.col("rollout_index").cast("string"))
    hexed = F.sha2(text.cast("binary"), 256)
    group = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(case).cast("string")).cast("binary"), 256), 1, 16)
    return grid.select(case, "rollout_index", group.alias("prompt_group_id"), u31(hexed).alias("sampling_seed"), F.substring(hexed, 1, 20).alias("episode_id"))


def evenly_spaced(rows: DataFrame, key: str, value: str, picks: int, extremes: int) -> DataFrame:
    """Rows at evenly spaced ranks of ``value``, and the ``extremes`` largest."""
    ranked = global_rank(rows.withColumn("_order", F.struct(value, key)), "_order")
    total = rows.agg(F.count("*").alias("_n"))
    step = F.greatest(F.floor((F.col("_n") - 1) / max(picks - 1, 1)), F.lit(1))
    chosen = (F.pmod("rank", step) == 0) & (F.col("rank") / step < picks) | (F.col("rank") >= F.col("_n") - extremes)
    return ranked.crossJoin(F.broadcast(total)).where(chosen).drop("_order", "_n")
