"""Session defaults and durable scratch tables in the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package; a cluster without it installed takes --py-files instead."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def local_session(app: str = "tracewright", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings a session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset and the session is local."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark.sparkContext.setCheckpointDir(place)
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


class Scratch:
    """Tables written under the shared folder, so that a lost executor costs a reread, not the lineage.

    ``save`` writes Parquet and rereads it; ``drop`` removes tables whose readers have all been saved. What is left goes
    when the session's JVM ends, as results that have not been read yet may still need it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracewright/{name}-{uuid.uuid4().hex}"
        self.count = 0
        folder, files = self._files(self.root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            folder, files = self._files(df.scratch_path)
            files.delete(folder, True)
