"""Exact choices of whole groups: two sums met at once, in a seeded order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.functions.hashing import seeded_hex


class InfeasibleError(ValueError):
    """No set of whole groups meets both sums."""


def first_reached(sizes: np.ndarray, count: int, supported: int) -> np.ndarray:
    """For each pair of sums up to the targets the first item, in order, with which a set of items so far has them; -1 for none.

    Nothing has (0, 0): it is reached before the first item, and holds -1 as well.
    """
    first = np.full((count + 1, supported + 1), -1, np.int64)
    reach = np.zeros((count + 1, supported + 1), bool)
    reach[0, 0] = True
    for i, (c, s) in enumerate(sizes.tolist()):
        fresh = reach[: count + 1 - c, : supported + 1 - s] & ~reach[c:, s:]
        first[c:, s:][fresh] = i
        reach[c:, s:] |= fresh
        if reach[count, supported]:
            break
    return first


def exact_groups(groups: DataFrame, seed: str, count: int, supported: int) -> DataFrame:
    """(group, count, supported, chosen) of every group; the chosen ones have exactly ``count`` rows, ``supported`` of them supported.

    Groups come in the order of sha256(seed:group), and the choice is the one that meets both sums with the shortest run of them;
    before its last group, again the shortest run that meets what is left, and so on. Of groups of one size only the first
    count // size can matter, as any other can be changed for one of those; these alone, a number that the targets bound
    whatever the number of groups, are put into a table of the sums that can be reached. Empty groups are never chosen.
    InfeasibleError if there is no such set.
    """
    sized = groups.withColumn("order_key", seeded_hex(seed, "group"))
    fit = sized.where((F.col("count") > 0) & (F.col("count") <= count) & (F.col("supported") <= supported))
    place = F.row_number().over(Window.partitionBy("count", "supported").orderBy("order_key", "group"))
    # the constant bound lets each task keep that many groups of a size before anything is sorted together
    held = fit.withColumn("place", place).where(F.col("place") <= count).where(F.col("place") * F.col("count") <= count)
    rows = sorted(held.select("order_key", "group", "count", "supported").collect())
    sizes = np.array([r[2:] for r in rows], np.int64).reshape(-1, 2)
    first, left, chosen = first_reached(sizes, count, supported), [count, supported], []
    while any(left):
        i = int(first[left[0], left[1]])
        if i < 0:
            raise InfeasibleError(f"no groups have {count} rows, {supported} of them supported")
        chosen.append(rows[i]["group"])
        left = [left[0] - int(sizes[i, 0]), left[1] - int(sizes[i, 1])]
    # at most ``count`` groups are chosen
    names = groups.sparkSession.createDataFrame([(g,) for g in chosen], groups.select("group").schema).withColumn("chosen", F.lit(True))
    return sized.join(F.broadcast(names), "group", "left").select("group", "count", "supported", F.coalesce("chosen", F.lit(False)).alias("chosen"))
