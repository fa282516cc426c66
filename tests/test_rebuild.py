"""Bundles compared by ranges: every planted change is found, and ranges that agree are not read."""

import shutil

from tracewright.operators import rebuild

KIND = "id long, s struct<a:int,t:struct<b:string,c:array<int>>>, m map<string,int>, x double"


def rows(n=400):
    return [(i, (i % 7, (None if i % 11 == 0 else f"t{i}", [i, i + 1])), {"k": i}, None if i % 13 == 0 else i / 3) for i in range(n)]


def test_planted_changes_are_all_found(spark, tmp_path):
    old = rows()
    new = [r for r in old if r[0] != 5] + [(1000, (1, ("new", [])), {}, 0.5)]
    new[20] = (new[20][0], (99, new[20][1][1]), new[20][2], new[20][3])
    new[40] = (new[40][0], (new[40][1][0], ("other", [7])), {"k": 0, "l": 1}, None)
    assert old[0][1][1][0] is None
    new[0] = (0, (0, ("was null", [0, 1])), {"k": 0}, None)
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    rebuild.write_bundle(spark.createDataFrame(old, KIND), a, "id")
    rebuild.write_bundle(spark.createDataFrame(new, KIND).repartition(5), b, "id")
    ranges, out = rebuild.compare_bundles(spark, a, b, "id")
    i, j = new[20][0], new[40][0]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (5, "missing", None, None, None), (1000, "added", None, None, None), (i, "changed", "s.a", str(i % 7), "99"), (0, "changed", "s.t.b", None, '"was null"'),
        (j, "changed", "s.t.b", f'"t{j}"', '"other"'), (j, "changed", "s.t.c", f"[{j},{j + 1}]", "[7]"), (j, "changed", "m", f'{{"k":{j}}}', '{"k":0,"l":1}'), (j, "changed", "x", str(j / 3), None),
    ], key=str)
    assert len(ranges) <= 5


def test_ranges_that_agree_are_not_read(spark, tmp_path):
    """Their folders are gone from both bundles, and the result is the same."""
    old = rows(60)
    new = [(i, s, m, 9.0 if i == 17 else x) for i, s, m, x in old]
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    for path, held in ((a, old), (b, new)):
        rebuild.write_bundle(spark.createDataFrame(held, KIND), path, "id", digits=1)
    want = [(17, "changed", "x", str(17 / 3), "9.0")]
    ranges, out = rebuild.compare_bundles(spark, a, b, "id")
    assert list(map(tuple, out.collect())) == want and len(ranges) == 1
    for path in (a, b):
        for k in "0123456789abcdef":
            if k != ranges[0]:
                shutil.rmtree(f"{path}/rows/key_range={k}", ignore_errors=True)
    assert list(map(tuple, rebuild.compare_bundles(spark, a, b, "id")[1].collect())) == want


def test_maps_are_told_in_key_order(spark):
    df = spark.range(1).selectExpr("map('b', map(2, 0, 1, 0), 'a', null) as m", "map('a', null, 'b', map(1, 0, 2, 0)) as w")
    got = df.select(*(rebuild.told(c, df.schema[c].dataType).alias(c) for c in "mw")).first()
    assert got.m == got.w == '{"a":null,"b":{"1":0,"2":0}}'


def test_equal_bundles(spark, tmp_path):
    for name, parts in (("a", 1), ("b", 7)):
        rebuild.write_bundle(spark.createDataFrame(rows(90), KIND).repartition(parts), f"{tmp_path}/{name}", "id")
    ranges, out = rebuild.compare_bundles(spark, f"{tmp_path}/a", f"{tmp_path}/b", "id")
    assert ranges == [] and out.count() == 0 and out.columns == ["id", "change", "field", "expected", "found"]


def test_digests_tell_nulls_and_copies(spark):
    def digest(held):
        df = spark.createDataFrame(held, "id long, x string")
        return [tuple(r) for r in rebuild.range_digests(df, [], rebuild.row_digest(df.schema)).collect()]

    some = [[(1, None)], [(1, "")], [(1, "null")], [(1, "a"), (2, "b")], [(1, "b"), (2, "a")], [(1, "a"), (1, "a")], [(1, "a")]]
    assert len({str(digest(x)) for x in some}) == len(some) and digest(some[3]) == digest(some[3][::-1])
