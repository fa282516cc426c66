"""Seeded-hash expressions: the same number for a key at every run and on every engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hex(seed: str, key: str | Column, separator: str = ":") -> Column:
    """sha256(seed + separator + key) in lower-case hex; sorting by it is a reproducible shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(seed + separator), key.cast("string")).cast("binary"), 256)


def short_id(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def u32(hexed: Column) -> Column:
    """The first four bytes of a hex digest as an integer."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def u31(hexed: Column) -> Column:
    return u32(hexed).bitwiseAND(F.lit(0x7FFFFFFF))


def uniform(hexed: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a hex digest, exact in double precision."""
    return F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def shard(key: str | Column, shards: int) -> Column:
    """sha256(key) modulo a number of shards, from the last 8 hex digits."""
    key = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.sha2(key.cast("string").cast("binary"), 256), 57, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(shards)).cast("int")
