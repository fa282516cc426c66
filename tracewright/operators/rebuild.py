"""A rebuilt bundle against the one it should equal: digests of key ranges first, and only ranges that differ are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def key_range(key: str, digits: int) -> Column:
    """The first hexadecimal digits of the sha256 of a key: a range that its rows share in any bundle."""
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), 1, digits)


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """A value whose maps, at any depth, tell their keys in order."""
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(value.isNotNull(), F.struct(*(in_key_order(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), in_key_order(F.element_at(value, k), kind.valueType).alias("value"))))
    return value


def row_digest(schema: T.StructType) -> Column:
    """The sha256 of a row as JSON, nulls told, columns and keys of maps in order."""
    held = F.struct(*(in_key_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(schema.fields, key=lambda f: f.name)))
    return F.sha2(F.to_json(held, {"ignoreNullFields": "false"}).cast("binary"), 256)


def range_digests(rows: DataFrame, by: list[str], digest: Column) -> DataFrame:
    """(range, n, a, b, c, d): the rows of each range and the sums of four parts of their digests, whatever their order."""
    part = lambda k: F.conv(F.substring(digest, 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(name) for k, name in enumerate("abcd")))


def write_bundle(rows: DataFrame, path: str, key: str, digits: int = 2) -> None:
    """Rows under ``path``/rows in folders by key range, with a manifest of the ranges' digests beside them.

    There are 16 ** digits ranges. Rows go to their folder's files by range and key, so that a large range is many files.
    """
    ranged = rows.withColumn("key_range", key_range(key, digits))
    ranged.repartitionByRange("key_range", key).write.partitionBy("key_range").mode("errorifexists").parquet(f"{path}/rows")
    held = rows.sparkSession.read.schema(ranged.schema).parquet(f"{path}/rows")
    range_digests(held, ["key_range"], row_digest(rows.schema)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Paths and types of the fields of nested structs; arrays and maps are fields as they are."""
    out = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        out += leaves(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) and f.dataType.fields else [(name, f.dataType)]
    return out


def told(path: str, kind: T.DataType) -> Column:
    """A field's value as JSON; null where it is null."""
    return F.when(F.col(path).isNotNull(), F.regexp_extract(F.to_json(F.struct(in_key_order(F.col(path), kind).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, change, field, expected, found): missing and added rows, and of rows in both every field that is not the same.

    Both have the same columns and each key once; fields of nested structs are told by path, values as JSON. A key that a side has
    more than once meets each of the other's rows.
    """
    fields = {p: kind for p, kind in leaves(a.schema) if p != f"`{key}`"}
    paths = [*fields]
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.struct(*(told(p, fields[p]).alias(p.replace("`", "")) for p in paths)).alias(name))
    both = side(a, "x").join(side(b, "y"), F.col("x_key").eqNullSafe(F.col("y_key")), "full_outer")
    change = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("changed")
    each = F.array(*(F.struct(F.lit(p.replace("`", "")).alias("field"), F.col(f"x.`{p.replace('`', '')}`").alias("expected"), F.col(f"y.`{p.replace('`', '')}`").alias("found")) for p in paths))
    apart = F.filter(each, lambda f: ~f["expected"].eqNullSafe(f["found"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("found")))
    rows = both.select(F.coalesce("x_key", "y_key").alias(key), change.alias("change"), F.explode(F.when(change == "changed", apart).otherwise(none)).alias("d"))
    return rows.select(key, "change", "d.field", "d.expected", "d.found")


def compare_bundles(spark: SparkSession, expected: str, found: str, key: str) -> tuple[list[str], DataFrame]:
    """(ranges that differ, their ``differences``) of two bundles written by ``write_bundle`` with the same digits and columns.

    Manifests are compared first, a row for each of a fixed number of ranges; the folders of ranges whose digests agree are never opened.
    """
    a, b = (spark.read.parquet(f"{p}/manifest") for p in (expected, found))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n", "a", "b", "c", "d")]
    wrong = a.alias("x").join(b.alias("y"), F.col("x.key_range") == F.col("y.key_range"), "full_outer").where(~(same[0] & same[1] & same[2] & same[3] & same[4]))
    ranges = sorted(r[0] for r in wrong.select(F.coalesce("x.key_range", "y.key_range")).collect())  # at most 16 ** digits
    x, y = (spark.read.parquet(f"{p}/rows").withColumn("key_range", F.col("key_range").cast("string")) for p in (expected, found))
    pick = lambda df: df.where(F.col("key_range").isin(ranges)).drop("key_range") if ranges else df.limit(0).drop("key_range")
    return ranges, differences(pick(x), pick(y), key)
