"""Every registered query with its oracle: name -> (builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a builder under its name; ``sql`` is the DuckDB statement that gives the same rows."""

    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _modules() -> None:
    from tracewright.plans import aggregates, audits, catalog, evidence, failures, joins, more, packages, reference, schemas, scores, selections, streams, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    _modules()
    return QUERIES


def oracles() -> dict[str, str]:
    _modules()
    return ORACLES
