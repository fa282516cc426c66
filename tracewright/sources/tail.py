"""A stream over growing line files, by byte offsets: each complete line once, also across restarts."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; the file counts up to ``end``, after a line feed."""

    path: str
    start: int
    stop: int
    end: int


def complete(path: str, size: int) -> int:
    """Where the last line that is complete in the first ``size`` bytes ends; read backwards, so only an unfinished line is read."""
    with open(path, "rb") as f:
        at = size
        while at:
            low = max(0, at - BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets are the ends of complete lines by path; bytes after the last line feed wait for the rest of their line."""

    def __init__(self, pattern: str, stretch: int):
        self.pattern, self.stretch = pattern, stretch

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # the sizes are taken first: what is appended meanwhile belongs to the next batch
        return {p: complete(p, os.stat(p).st_size) for p in sorted(glob.glob(self.pattern))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path in sorted({*start, *end}):
            a, b = start.get(path, 0), end.get(path, -1)
            if b < a:
                raise RuntimeError(f"{path} shrank: {a} bytes were read, {'it is gone' if b < 0 else f'{b} are there'}")
            out += [Stretch(path, x, min(x + self.stretch, b), b) for x in range(a, b, self.stretch)]
        # Spark asks for one partition at least
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.start >= partition.stop:
            return
        with open(partition.path, "rb") as f:
            # a line belongs to the stretch in which it begins
            f.seek(max(0, partition.start - 1))
            if partition.start and f.read(1) != b"\n":
                f.readline()
            while (at := f.tell()) < partition.stop:
                line = f.readline(partition.end - at).rstrip(b"\r\n")
                if line.strip():
                    yield partition.path, at, line.decode(errors="replace")


class LineTail(DataSource):
    """``spark.readStream.format("line_tail").option("stretch", bytes).load(pattern)``: (path, at, value) of each line that is not blank.

    Files may grow and come; one that shrinks or goes is an error. The pattern names files that the driver and all executors can open, such as
    a mounted shared folder. Long files are read as stretches of bytes in tasks of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"].removeprefix("file:"), int(self.options.get("stretch", 64 << 20)))


def tail(spark: SparkSession, pattern: str, stretch: int = 64 << 20) -> DataFrame:
    """A stream of (path, at, value) over the files of a pattern."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("stretch", stretch).load(pattern)


def offsets(checkpoint: str) -> dict:
    """The offsets that a query's checkpoint has come to, of its last planned batch."""
    last = max((f for f in os.listdir(f"{checkpoint}/offsets") if f.isdigit()), key=int)
    with open(f"{checkpoint}/offsets/{last}") as f:
        return json.loads(f.read().splitlines()[2])
