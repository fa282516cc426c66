"""Values nested in JSON texts to any depth: walks, private-field scans, redaction, canonical form."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

WALK = "array<struct<path:string,key:string,value:string>>"


def _walk(value, path="$", key=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}", k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{path}[{i}]", key)
    else:
        yield path, key, value if isinstance(value, str) else json.dumps(value)


def _load(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def walk(text: Column) -> Column:
    """(path, key, value) of every leaf, in document order; empty for what is not JSON."""

    @F.pandas_udf(WALK)
    def leaves(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [] if (v := _load(t)) is None else [dict(zip(("path", "key", "value"), x)) for x in _walk(v)])

    return leaves(text)


def private_paths(text: Column, forbidden: list[str]) -> Column:
    """Paths of leaves and branches whose key is forbidden, at any depth; sorted."""
    names = {f.lower() for f in forbidden}

    def scan(value, path="$"):
        if isinstance(value, dict):
            for k, v in value.items():
                if k.lower() in names:
                    yield f"{path}.{k}"
                yield from scan(v, f"{path}.{k}")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from scan(v, f"{path}[{i}]")

    @F.pandas_udf("array<string>")
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sorted(scan(_load(t))))

    return found(text)


def without(text: Column, pattern: str) -> Column:
    """The JSON without any object that holds, itself, a string matching a pattern; canonical form, null where nothing is left."""
    bad = re.compile(pattern)
    gone = object()

    def clean(value):
        if isinstance(value, dict):
            if any(isinstance(v, str) and bad.search(v) for v in value.values()):
                return gone
            return {k: c for k, v in value.items() if (c := clean(v)) is not gone}
        if isinstance(value, list):
            return [c for v in value if (c := clean(v)) is not gone]
        return value

    @F.pandas_udf("string")
    def kept(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if (v := _load(t)) is None or (c := clean(v)) is gone else json.dumps(c, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return kept(text)


def canonical(text: Column) -> Column:
    """JSON with sorted keys, no spaces and unescaped characters; null for what is not JSON."""

    @F.pandas_udf("string")
    def form(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if (v := _load(t)) is None else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return form(text)


def compact(text: Column, depth: int, most: int) -> Column:
    """JSON cut at a depth and with long strings clipped."""

    def cut(value, left):
        if isinstance(value, str):
            return value if len(value) <= most else value[:most] + "…"
        if isinstance(value, (dict, list)) and not left:
            return "…"
        if isinstance(value, dict):
            return {k: cut(v, left - 1) for k, v in value.items()}
        return [cut(v, left - 1) for v in value] if isinstance(value, list) else value

    @F.pandas_udf("string")
    def form(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if (v := _load(t)) is None else json.dumps(cut(v, depth), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return form(text)
