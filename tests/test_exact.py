"""Exact choices of whole groups against tables of all sums and all subsets."""

import hashlib
import itertools
import random

import pytest

from tracewright.operators import exact

KIND = "group long, count long, supported long"


def in_order(groups, seed, target):
    """The table that holds, for each pair of sums, the first set of groups that has it."""
    chosen = {(0, 0): ()}
    for g, c, s in sorted(groups, key=lambda g: hashlib.sha256(f"{seed}:{g[0]}".encode()).hexdigest()):
        if c <= 0:
            continue
        for (a, b), have in list(chosen.items()):
            if a + c <= target[0] and b + s <= target[1]:
                chosen.setdefault((a + c, b + s), (*have, g))
    return chosen.get(target)


@pytest.mark.parametrize("seed", ["a", "b", "c"])
def test_choice_is_that_of_the_whole_table(spark, seed):
    rng = random.Random(seed)
    groups = [(i, c, rng.randrange(0, c + 1)) for i, c in enumerate(rng.choice([1, 1, 1, 2, 3, 7]) for _ in range(70))] + [(900, 0, 0), (901, 500, 3)]
    for target in [(20, 9), (1, 0), (33, 33), (0, 0)]:
        want = in_order(groups, seed, target)
        if want is None:
            with pytest.raises(exact.InfeasibleError):
                exact.exact_groups(spark.createDataFrame(groups, KIND), seed, *target)
            continue
        rows = exact.exact_groups(spark.createDataFrame(groups, KIND).repartition(3), seed, *target).collect()
        assert {r.group for r in rows if r.chosen} == set(want) and len(rows) == len(groups)
        assert (sum(r["count"] for r in rows if r.chosen), sum(r.supported for r in rows if r.chosen)) == target


def test_feasible_where_any_subset_is(spark):
    """Sums of even sizes only: every target against all subsets."""
    groups = [(1, 2, 1), (2, 4, 0), (3, 4, 3), (4, 6, 6), (5, 2, 2)]
    sums = {(sum(g[1] for g in x), sum(g[2] for g in x)) for k in range(6) for x in itertools.combinations(groups, k)}
    df = spark.createDataFrame(groups, KIND)
    for target in [(2, 1), (2, 0), (6, 1), (8, 3), (18, 12), (5, 1), (8, 8)]:
        if target in sums:
            rows = [r for r in exact.exact_groups(df, "s", *target).collect() if r.chosen]
            assert (sum(r["count"] for r in rows), sum(r.supported for r in rows)) == target
        else:
            with pytest.raises(exact.InfeasibleError):
                exact.exact_groups(df, "s", *target)


def test_what_reaches_the_driver_is_bounded_by_the_targets(spark):
    """50,000 groups of one row: 12 of them can matter."""
    df = spark.range(50_000).selectExpr("id as group", "cast(1 as bigint) as count", "id % 2 as supported")
    rows = exact.exact_groups(df, "s", 6, 3).where("chosen").collect()
    assert len(rows) == 6 and sum(r.supported for r in rows) == 3
    with pytest.raises(exact.InfeasibleError):
        exact.exact_groups(spark.createDataFrame([], KIND), "s", 1, 0)
