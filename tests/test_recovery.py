"""The recovery index over a growing archive, restarted between batches."""

import json
import time

from pyspark.sql import functions as F

from tracewright.sources import tail
from tracewright.streaming import recovery


def archive(spark, pattern):
    rows = tail.tail(spark, pattern)
    item = F.from_json("value", "key string, attempt long, value string")
    return rows.select(item.alias("i"), "at").select("i.key", "i.attempt", "at", "i.value")


def add(path, *items):
    with open(path, "a") as f:
        f.writelines((json.dumps(dict(zip(("key", "attempt", "value"), i))) if isinstance(i, tuple) else i) + "\n" for i in items)


def test_newer_attempts_win_across_restarts(spark, tmp_path):
    path, table, mark = tmp_path / "items.jsonl", f"{tmp_path}/index", f"{tmp_path}/mark"
    held = lambda: {r.key: (r.attempt, r.value) for r in recovery.index(spark, table).collect()}
    run = lambda: recovery.materialised(recovery.recovery_index(archive(spark, str(path))), table, mark)
    add(path, ("a", 1, "a1"), ("b", 2, "b2"), "not json", ("", 1, "x"), (None, 1, "x"), ("c", None, "x"), ("a", 1, "a1 again"))
    run()
    assert held() == {"a": (1, "a1 again"), "b": (2, "b2")}
    add(path, ("b", 1, "late b1"), ("a", 3, "a3"), ("d", 1, "d1"), ("a", 2, "late a2"))
    run()
    assert held() == {"a": (3, "a3"), "b": (2, "b2"), "d": (1, "d1")}
    run()  # nothing new
    assert held() == {"a": (3, "a3"), "b": (2, "b2"), "d": (1, "d1")}


def test_state_goes_after_its_time(spark, tmp_path):
    """An older attempt counts again once the newer one's time is over."""
    path, table, mark = tmp_path / "items.jsonl", f"{tmp_path}/index", f"{tmp_path}/mark"
    run = lambda: recovery.materialised(recovery.recovery_index(archive(spark, str(path)), ttl_ms=1000), table, mark)
    add(path, ("a", 5, "new"))
    run()
    time.sleep(1.5)
    add(path, ("a", 2, "old"))
    run()
    assert [(r.attempt, r.value) for r in recovery.index(spark, table).collect()] == [(2, "old")]


def test_keys_without_a_time_to_live_cost_no_python(spark, tmp_path):
    path, table = str(tmp_path / "items"), f"{tmp_path}/index"
    spark.createDataFrame([(str(i % 3), i // 3, i, str(i)) for i in range(12)], "key string, attempt long, at long, value string").repartition(4).write.parquet(path)
    items = spark.readStream.schema("key string, attempt long, at long, value string").parquet(path)
    found = recovery.recovery_index(items)
    assert "Python" not in found._jdf.queryExecution().analyzed().toString() and "PySpark" not in found._jdf.queryExecution().analyzed().toString()
    recovery.materialised(found, table, f"{tmp_path}/mark")
    assert sorted(map(tuple, recovery.index(spark, table).collect())) == [(str(k), 3, 9 + k, str(9 + k)) for k in range(3)]
