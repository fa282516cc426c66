"""Growing line files: no line is lost or repeated, whatever is appended and whenever the query restarts."""

import random

import pytest
from pyspark.errors import StreamingQueryException

from tracewright.sources import tail


def run(spark, pattern, out, mark, stretch=64 << 20):
    query = tail.tail(spark, pattern, stretch).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.path.rsplit("/", 1)[1], r.at, r.value) for r in spark.read.schema("path string, at long, value string").parquet(out).collect())


def lines_of(files):
    out = []
    for name, data in files.items():
        at = 0
        for line in data[: data.rfind(b"\n") + 1].split(b"\n")[:-1]:
            if line.strip():
                out.append((name, at, line.decode().rstrip("\r")))
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("stretch", [64 << 20, 7])
def test_restarts_neither_lose_nor_repeat(spark, tmp_path, stretch):
    """Six runs of one checkpoint over files that grow by whole and torn lines, and a file that comes later."""
    rng, files = random.Random(stretch), {"a.jsonl": b"", "b.jsonl": b'{"torn": '}
    (tmp_path / "in").mkdir()
    pattern, out, mark = f"{tmp_path}/in/*.jsonl", f"{tmp_path}/out", f"{tmp_path}/mark"
    for turn in range(6):
        if turn == 3:
            files["c.jsonl"] = b"first\n\n  \nlast, torn"
        for name in files:
            files[name] += "".join(rng.choice(["é日x\n", '{"k": 1}\n', "half", "\n", "\r\n", "word word word\n"]) for _ in range(rng.randrange(0, 9))).encode()
            (tmp_path / "in" / name).write_bytes(files[name])
        assert run(spark, pattern, out, mark, stretch) == lines_of(files)
    assert tail.offsets(mark) == {f"{tmp_path}/in/{n}": d.rfind(b"\n") + 1 for n, d in files.items()}


@pytest.mark.parametrize("left", [b"one\n", None])
def test_files_that_shrink_or_go_are_an_error(spark, tmp_path, left):
    path, out, mark = tmp_path / "x.jsonl", f"{tmp_path}/out", f"{tmp_path}/mark"
    path.write_bytes(b"one\ntwo\n")
    assert len(run(spark, str(path), out, mark)) == 2
    path.unlink() if left is None else path.write_bytes(left)
    with pytest.raises(StreamingQueryException, match="shrank"):
        run(spark, str(path), out, mark)


def test_the_end_of_the_last_line_is_found_backwards(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 3)
    path = tmp_path / "x"
    for data in [b"", b"torn", b"\n", b"a\nbcdefghij", b"abc\n", b"ab\ncdef\n\ngh"]:
        path.write_bytes(data)
        for size in range(len(data) + 1):
            assert tail.complete(str(path), size) == data[:size].rfind(b"\n") + 1
