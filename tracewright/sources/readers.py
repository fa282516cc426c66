"""Readers: JSON lines strict and tolerant, torn tails, documents, manifests, logs, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracewright.operators.checks import ExpectationError, require_unique


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip by suffix, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines without those that are malformed."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_quarantine(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): every non-blank line is in one of them."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.try_parse_json("value").alias("v"))
    parsed = lines.select("value", "v", F.from_json("value", schema).alias("row"))
    is_object = F.col("v").isNotNull() & F.ltrim("value").startswith("{")
    return parsed.where(is_object).select("row.*"), parsed.where(~is_object).select("value")


def jsonl_torn(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of an append-only file whose last line may be cut off; any other malformed line is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"), F.size(F.split("value", "\n")).alias("n"))
    parsed = lines.where("trim(line) <> ''").select("pos", "n", F.try_parse_json("line").isNull().alias("bad"), F.from_json("line", schema).alias("row"))
    if found := parsed.where("bad and pos < n - 1").select("pos").limit(3).collect():
        raise ExpectationError(f"malformed lines before the last: {[r['pos'] + 1 for r in found]}")
    return parsed.where("not bad").select("row.*")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object for each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, split) from JSON lines, a list, an object holding cases, items or records, or an {id: split} map.

    One case under two splits is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    entry = "array<struct<case_id:string,split:string>>"
    first = F.substring_index("value", "\n", 1)
    by_line = (first != F.col("value")) & first.startswith("{") & F.try_parse_json(first).isNotNull()
    whole = text.select("value", F.when(~by_line, F.try_parse_json("value")).alias("v"))
    lists = whole.where("value like '[%' and v is not null").select(F.from_json("value", entry).alias("rows"))
    objects = whole.where("value like '{%' and v is not null")
    holders = "struct<cases:{0},items:{0},records:{0}>".format(entry)
    held = objects.select("value", F.from_json("value", holders).alias("o")).withColumn("rows", F.coalesce("o.cases", "o.items", "o.records"))
    maps = held.where("rows is null").select(F.explode(F.from_json("value", "map<string,string>")).alias("case_id", "split"))
    lines = whole.where("v is null").select(F.explode(F.split("value", "\n")).alias("line")).where("trim(line) <> ''")
    lines = lines.select(F.from_json("line", "struct<case_id:string,split:string>").alias("r")).select("r.*")
    rows = lists.unionByName(held.where("rows is not null").select("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return require_unique(rows.unionByName(maps).unionByName(lines).distinct(), ["case_id"], "manifest")


def tsv(spark: SparkSession, path: str, columns: list[str], unique: list[str]) -> DataFrame:
    """A tab-separated table with a header that must have ``columns``, unique by a key."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if missing := set(columns) - set(rows.columns):
        raise ExpectationError(f"missing columns: {sorted(missing)}")
    return require_unique(rows, unique, "table")


def metric_lines(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(line, metrics): log lines that hold a dict literal with a known key, as a map of its numbers."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", r"(\{.*\})", 1).alias("literal"))
    quoted = F.replace("literal", F.lit("'"), F.lit('"'))
    strings = F.from_json(quoted, "map<string,string>")
    numbers = F.map_filter(F.transform_values(strings, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    return lines.select("line", numbers.alias("metrics")).where(F.arrays_overlap(F.map_keys("metrics"), F.array(*map(F.lit, known))))


def log_matches(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(name, lines, first): how many log lines match each pattern, and the text of the first."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    names = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), n) for n, p in patterns.items())))
    hits = lines.select("at", "value", F.explode(names).alias("name"))
    return hits.groupBy("name").agg(F.count("*").alias("lines"), F.min_by("value", "at").alias("first"))


def tail(spark: SparkSession, path: str, n: int, schema: T.StructType | str) -> DataFrame:
    """Of the last n non-blank lines those that parse, in file order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").where("trim(value) <> ''")
    last = lines.orderBy(F.desc("at")).limit(n)
    return last.where(F.try_parse_json("value").isNotNull()).orderBy("at").select(F.from_json("value", schema).alias("row")).select("row.*")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, size, modified) of the files under a path; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).agg(F.max_by(F.struct("path", "size", "modified"), F.struct("modified", "path")).alias("f")).select("f.*")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(folder, step, files, bytes, has_optimizer, has_scheduler) of checkpoint folders named with their step."""
    step = F.regexp_extract("folder", r"checkpoint-([0-9]+)$", 1)
    rows = files(spark, path).withColumn("step", F.nullif(step, F.lit("")).cast("long")).where("step is not null")
    return rows.groupBy("folder", "step").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.bool_or(F.col("name").startswith("optimizer")).alias("has_optimizer"), F.bool_or(F.col("name").startswith("scheduler")).alias("has_scheduler"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tagged_union(inputs: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Several tables in one, each row with its input's name."""
    out = None
    for name, df in inputs.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ExpectationError("no inputs")
    return out
