"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a temporary one, if all runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "passagemill-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/passagemill-{what}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """A path below this one, which is deleted when the driver's process ends, whether or not the session was stopped."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/table"


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """The rows, written to the shared folder and read back: no lineage, and nothing that dies with an executor. For
    results, which callers may read as long as the application runs."""
    path = kept_until_exit(df.sparkSession, scratch(df.sparkSession, what))
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batch_bytes(spark: SparkSession, size: int = 32 << 20):
    """What runs inside sends about so many bytes to Python at once: for rows that may be large."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffles_deleted(spark: SparkSession):
    """What is written inside leaves no shuffle files behind, which otherwise stay until the driver collects garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Workspace:
    """Tables in the shared folder that go when the work inside is done; what is left of it must be saved outside."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, what: str = "table") -> DataFrame:
        path = scratch(self.spark, what)
        self.paths.append(path)
        with shuffles_deleted(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, which nothing reads any more."""
        gone = [p for p in self.paths if p.rsplit("/passagemill-", 1)[1].rsplit("-", 1)[0] in names]
        deleted(self.spark, gone)
        self.paths = [p for p in self.paths if p not in gone]

    def keep_last(self) -> None:
        """Delete all but the newest table."""
        deleted(self.spark, self.paths[:-1])
        self.paths = self.paths[-1:]

    def clear(self) -> None:
        deleted(self.spark, self.paths)
        self.paths = []
