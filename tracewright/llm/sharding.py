"""Consistent placement by a permutation-filled lookup table; DataFrame functions only.

Each shard prefers the slots of a prime-sized table in an order of its own, offset + j * skip (mod size), where
offset and skip come from hashes of its name. Shards take turns; at its turn a shard claims the first slot of its
order that is still free, until the table is full. Shards then hold the same number of slots, give or take one,
and adding or removing a shard moves few keys. The table, whose size is fixed by a parameter and checked against
``MOST_SLOTS``, is broadcast, and a key is placed by one lookup of its hash.

Defined results: a null key is placed like the empty string; equal keys go to the same shard; other columns are kept.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MOST_SLOTS = 1 << 20


def number(text: str, at: int) -> int:
    """Eight hex digits of a text's MD5 as an integer; SQL can say the same."""
    return int(md5(text.encode()).hexdigest()[at : at + 8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int) -> list[int]:
    """The shard number of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be present and distinct")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [number(s, 0) % slots for s in shards]
    skip = [number(s, 8) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard, shard_name), ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select("slot", F.col("owner").cast("int").alias("shard")).select("*", names[F.col("shard")].alias("shard_name"))


def slot_of(key: Column, slots: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """``rows`` with (slot, shard, shard_name) of their keys; columns of those names are replaced."""
    kept = rows.drop("slot", "shard", "shard_name").withColumn("slot", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot")
