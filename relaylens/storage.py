"""Folders of the index, looked up on the driver through Hadoop's file systems (any scheme that Spark reads).

Listings here have one entry per run, never one per record or file of data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str, modified_ms: int) -> None:
    """Renames a file and sets its modification time."""
    fs, p = _path(spark, path)
    _, target = _path(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}")
    fs.setTimes(target, modified_ms, -1)


def read_bytes(spark: SparkSession, path: str, offset: int, n: int) -> bytes:
    """Part of a file whose scheme only Hadoop knows."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def runs(spark: SparkSession, path: str, committed: bool = False) -> list[int]:
    """Numbers of the ``run=N`` folders under ``path``; with ``committed`` only those whose write ended."""
    found = [n for n in names(spark, path) if n.startswith("run=")]
    return sorted(int(n[4:]) for n in found if not committed or exists(spark, f"{path}/{n}/_SUCCESS"))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder; 0 if it does not exist."""
    fs, p = _path(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all; fails if it exists."""
    fs, p = _path(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(aside, p):
        fs.delete(aside, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it does not exist (any more)."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Scratch:
    """Tables of one job in the shared checkpoint folder, gone when the job ends, also if it fails.

    A table that was kept is not computed again, whichever executors are lost."""

    def __init__(self, spark: SparkSession):
        from .session import checkpoint_dir

        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/relaylens-job-{uuid.uuid4().hex}"
        self.tables = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        at = f"{self.path}/{self.tables}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
