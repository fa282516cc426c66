"""How text filters interact in every order: additive counts of the filters' failures, by part of the corpus.

Each filter's failure is a bit of a row's mask; a table of (part, mask) counts, at most 32 rows a part, answers every
order of the filters, so texts are read once and orders cost nothing that grows with the rows.

The filter on repeats needs, for each text, the least id that has it. A counting Bloom sketch comes first: each task
counts its rows' texts in two-bit counters (none, one, more), the sketches are merged by slices, and a text with a counter
that stands at one is unique for certain. Only the others, with copies collapsed inside each task, are shuffled by
their full text for its least id. The sketch has ``PER_ROW`` counters a row and at most ``MOST_COUNTERS`` (32 MiB), which bounds
what is broadcast; beyond that it clears fewer texts, and what it doesn't clear is grouped exactly all the same.

Defined results: null texts are empty; empty texts are equal to each other; of rows that share an id none is a repeat of
the other; a row with a null id repeats nothing and nothing repeats it; a row without labels has neither; of several labels of an
id, any that is 1 counts; a null part is the empty string; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.session import Scratch

FILTERS = "ABCDE"
PER_ROW, MOST_COUNTERS, SLICE, PROBES = 8, 1 << 27, 1 << 16, 2
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Of each filter that looks at one text alone, whether the text fails it."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars, capitals = F.char_length(text), F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 3 * chars.cast("long"), "D": F.regexp_like(text, F.lit(r"[#$%&*|]"))}


def probes(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of ``PROBES`` counters of 64-bit hashes, in a sketch of a power of two of them."""
    h = h.view(np.uint64)
    return [((h >> np.uint64(31 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]


def pack(counters: np.ndarray) -> bytes:
    return (counters[0::4] | counters[1::4] << 2 | counters[2::4] << 4 | counters[3::4] << 6).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, np.uint8)
    return np.stack([held >> 2 * k & 3 for k in range(4)], axis=1).ravel()


def _counts(size):
    """The sketch of a task's hashes, as slices that hold anything; a text that hits a counter twice counts twice in it."""

    def counted(batches):
        counters = np.zeros(size, np.uint8)
        for batch in batches:
            for at in probes(batch.column(0).to_numpy(), size):
                places, times = np.unique(at, return_counts=True)
                counters[places] = np.minimum(counters[places] + times, 2)
        width = min(size, SLICE)
        used = np.flatnonzero(counters.reshape(-1, width).any(axis=1))
        for k in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pack(counters[k * width : (k + 1) * width])])], ["slice", "counters"])

    return counted


def _merged(batches):
    """Counters of one slice, whose rows stand beside each other, added up; two means two or more."""
    now, total = None, None
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != now and now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([pack(total)])], ["slice", "counters"])
                total = None
            total, now = unpack(data) if total is None else np.minimum(total + unpack(data), 2), k
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([pack(total)])], ["slice", "counters"])


def sketch(hashes: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """The merged sketch of the column ``h`` of at most ``rows`` rows: its counters and their packed bytes.

    Its size is bounded by ``MOST_COUNTERS``, and so is what comes to the driver: merged counters, no row's hash.
    """
    size = 1 << 12
    while size < min(rows * PER_ROW, MOST_COUNTERS):
        size *= 2
    slices = hashes.select("h").mapInArrow(_counts(size), "slice long, counters binary")
    merged = slices.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice long, counters binary")
    width, out = min(size, SLICE) // 4, np.zeros(size // 4, np.uint8)
    for row in merged.toLocalIterator():
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.counters, np.uint8)
    return size, out


def possible_repeat(held: Broadcast, size: int):
    """A function of a hash: whether the sketch cannot clear its text, as no counter of it stands at one."""

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        crowded, counters = np.ones(len(h), bool), held.value
        for at in probes(h.to_numpy(), size):
            crowded &= (counters[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) >= 2
        return pd.Series(crowded)

    return asked


def masks(docs: DataFrame, scratch: Scratch, id: str, text: str, part: str) -> DataFrame:
    """(id, part, mask) of every row; bit k of the mask says that the row fails the k-th filter."""
    whole = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    own = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    # F.xxhash64 only routes and clears; texts that may repeat are compared whole
    facts = scratch.save(whole.select("id", "part", own.alias("own"), F.xxhash64("text").alias("h")), "facts")
    named = facts.where("id is not null").select("h")
    size, held = sketch(named, named.count())
    asked = possible_repeat(docs.sparkSession.sparkContext.broadcast(held), size)
    # no join here: a text that is cleared never leaves its task
    texts = scratch.save(whole.where("id is not null").where(asked(F.xxhash64("text"))).select("id", "text"), "texts")
    least = texts.groupBy("text").agg(F.min("id").alias("least"))
    repeats = texts.join(least, "text").where("id > least").select("id", F.xxhash64("text").alias("h")).distinct()
    return facts.join(repeats.withColumn("again", F.lit(1 << FILTERS.index("E"))), ["id", "h"], "left").select("id", "part", (F.col("own") + F.coalesce("again", F.lit(0))).alias("mask"))


def orders() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, mask of the filters before it, its own bit) of every step of every order."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(o), i + 1, f, sum(bit[x] for x in o[:i]), bit[f]) for o in permutations(FILTERS) for i, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order and step: (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    scratch = Scratch(docs.sparkSession, "audit")
    marked = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks(docs, scratch, id, text, part).join(marked, "id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("rows"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("masks"))  # at most 32
    steps = F.from_json(F.lit(str([list(map(str, o)) for o in orders()]).replace("'", '"')), "array<array<string>>")
    each = held.select("part", "masks", F.explode(steps).alias("o"))
    each = each.select("part", "masks", F.col("o")[0].alias("filter_order"), F.col("o")[1].cast("int").alias("step"), F.col("o")[2].alias("filter"), F.col("o")[3].cast("int").alias("before"), F.col("o")[4].cast("int").alias("bit"))

    def total(holds, of="rows"):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda so_far, m: so_far + F.when(holds(m["mask"]), m[of]).otherwise(0))

    before, bit = F.col("before"), F.col("bit")
    fails, fresh = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) == 0
    told = each.select(
        "part", "filter_order", "step", "filter",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(lambda m: fails(m) & fresh(m)).alias("removed"),
        total(lambda m: fails(m) & ~fresh(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(lambda m: fails(m) & fresh(m), "good").alias("good_lost"),
        total(lambda m: fails(m) & fresh(m), "toxic").alias("toxic_lost"),
    )
    told = scratch.save(told, "told")
    shares = told.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return told.join(shares, ["part", "filter"])
