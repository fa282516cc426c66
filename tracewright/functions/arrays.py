"""Array expressions: softmax, top-k, sparse and dense forms, causal shift."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax(values: Column) -> Column:
    """Max-shifted softmax of an array."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v.cast("double") - top.cast("double")))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def top_k(values: Column, k: int) -> Column:
    """The k largest as structs (value, id), ties by smaller id; ids are positions from 0."""
    rows = F.transform(values, lambda v, i: F.struct((-v.cast("double")).alias("key"), i.alias("id"), v.cast("double").alias("value")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(r["id"].alias("id"), r["value"].alias("value")))


def renormalised(rows: Column) -> Column:
    """Probabilities of (id, value) structs, by a softmax over their values."""
    top = F.array_max(F.transform(rows, lambda r: r["value"]))
    total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.exp(r["value"] - top))
    return F.transform(rows, lambda r: F.struct(r["id"].alias("id"), (F.exp(r["value"] - top) / total).alias("prob")))


def sparse(values: Column, keep) -> Column:
    """(position, value) structs of the entries that ``keep`` holds true for."""
    rows = F.transform(values, lambda v, i: F.struct(i.alias("position"), v.alias("value")))
    return F.filter(rows, lambda r: keep(r["value"]))


def dense(rows: Column, size: Column, empty: Column) -> Column:
    """The array of ``size`` entries that (position, value) structs describe."""
    place = F.map_from_entries(rows)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at(place, i), empty))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def causal_targets(prompt: Column, completion: Column) -> Column:
    """Positions whose next token is of the completion: len(prompt) + i - 1."""
    return F.transform(completion, lambda _, i: F.size(prompt) + i - 1)


def causal_input(prompt: Column, completion: Column) -> Column:
    whole = F.concat(prompt, completion)
    return F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0)))


def weighted_present_mean(parts: Column) -> Column:
    """The mean of (value, weight) structs whose value is there and whose weight is positive; null where none is."""
    live = F.filter(parts, lambda p: p["value"].isNotNull() & (p["weight"] > 0))
    total = F.aggregate(live, F.lit(0.0), lambda a, p: a + p["weight"])
    return F.try_divide(F.aggregate(live, F.lit(0.0), lambda a, p: a + p["value"] * p["weight"]), total)
