"""Helpers shared by the operators: reading a table, cutting lineage in the shared folder, words."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.session import checkpoint_dir, ship_package

# The white space that separates words: space and the characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
_STORED: dict[int, tuple[str, DataFrame]] = {}  # tables by the frame that reads them
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships the package to Python workers and names the checkpoint folder."""
    ship_package(spark)
    checkpoint_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, in a folder of this application.

    ``clear_scratch`` removes that folder; results that are read lazily need it until then."""
    app = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark)}/llm-{app}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes everything ``scratch_path`` named in this application; call when its results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lost executors don't send later work to the start."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _STORED[id(back)] = (path, back)
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = _STORED.pop(id(df), None)
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path[0])
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs that nothing refers to: it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Tables written inside reach Python in batches of about ``size`` bytes, at least a row; without, one holds up to 10,000 whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once.

    Inside a lambda a column's expression would be computed again for every element, also where the optimiser
    puts it there (as it moves a filter below a projection); a lambda's variable is not."""
    return F.get(F.transform(F.array(value), f), 0)


def bucket(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_interval(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 48)).cast("double") / F.lit(float(1 << 48))
