import gzip
import json

import pytest

from tracewright.operators.checks import ExpectationError
from tracewright.sources import readers, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl_readers(spark, tmp_path):
    good, bad = '{"a": 1}\n\n{"a": 2}\n', '{"a": 1}\nnope\n{"a": 3}\n'
    assert [r.a for r in readers.jsonl(spark, put(tmp_path / "g.jsonl", good), "a int").collect()] == [1, 2]
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as f:
        f.write(good)
    assert readers.jsonl(spark, str(tmp_path / "g.jsonl.gz"), "a int").count() == 2
    b = put(tmp_path / "b.jsonl", bad)
    assert sorted(r.a for r in readers.jsonl_tolerant(spark, b, "a int").collect()) == [1, 3]
    rows, rejected = readers.jsonl_quarantine(spark, b, "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 3] and [r.value for r in rejected.collect()] == ["nope"]
    with pytest.raises(Exception):
        readers.jsonl(spark, b, "a int").collect()


def test_torn_tail(spark, tmp_path):
    torn = put(tmp_path / "t.jsonl", '{"a": 1}\n{"a": 2}\n{"a"')
    assert [r.a for r in readers.jsonl_torn(spark, torn, "a int").collect()] == [1, 2]
    with pytest.raises(ExpectationError):
        readers.jsonl_torn(spark, put(tmp_path / "u.jsonl", '{"a"\n{"a": 2}\n'), "a int")


@pytest.mark.parametrize(
    "text",
    ['[{"case_id": "x", "split": "train"}]', '{"items": [{"case_id": "x", "split": "train"}]}', '{"x": "train"}', '{"case_id": "x", "split": "train"}\n{"case_id": "x", "split": "train"}\n'],
)
def test_manifest_shapes(spark, tmp_path, text):
    assert [tuple(r) for r in readers.manifest(spark, put(tmp_path / "m", text)).collect()] == [("x", "train")]


def test_manifest_conflict(spark, tmp_path):
    with pytest.raises(ExpectationError):
        readers.manifest(spark, put(tmp_path / "m", '[{"case_id": "x", "split": "a"}, {"case_id": "x", "split": "b"}]'))


def test_logs_and_files(spark, tmp_path):
    log = put(tmp_path / "run.log", "start\n{'loss': '1.5', 'step': 3}\nCUDA error\n{'other': 1}\n")
    assert [r.metrics for r in readers.metric_lines(spark, log, ["loss"]).collect()] == [{"loss": 1.5, "step": 3.0}]
    assert [(r.name, r.lines) for r in readers.log_matches(spark, log, {"cuda": "CUDA", "none": "zzz"}).collect()] == [("cuda", 1)]
    folder = tmp_path / "checkpoint-40"
    folder.mkdir()
    put(folder / "optimizer.pt", "abc")
    got = readers.checkpoints(spark, str(tmp_path)).first()
    assert (got.step, got.files, got.bytes, got.has_optimizer, got.has_scheduler) == (40, 1, 3, True, False)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z")], "id long, route string, body string")
    assert {r.route: r.rows for r in sinks.routed(df, f"{tmp_path}/r", "route").collect()} == {"a": 2, "b": 1}
    sinks.jsonl(df, f"{tmp_path}/j")
    line = readers.jsonl(spark, f"{tmp_path}/j", "id long, route string, body string")
    assert line.count() == 3
    with pytest.raises(Exception):
        sinks.jsonl(df, f"{tmp_path}/j")
    blobs = df.selectExpr("cast(route as binary) as content")
    assert sinks.put_blobs(blobs, "content", f"{tmp_path}/blobs").count() == 3
    sinks.put_blobs(blobs, "content", f"{tmp_path}/blobs")
    assert spark.read.parquet(f"{tmp_path}/blobs").count() == 2
    assert json.dumps(sinks.markdown(df, ["id", "body"], ["id"]).first().markdown).count("|") == 3 * 5
