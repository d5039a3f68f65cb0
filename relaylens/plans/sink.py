"""Sinks (SNK-1..3): the delivery index, the open queues, JSON rows.

Every table of an index holds one folder per run (``run=N``).  A run writes its folders in any order; its entry
in the commit log (``commits``) makes them count.  Readers take live runs only and list only
their folders, so a run that failed half-way leaves nothing that counts, and its rerun starts from the same state.

Layout of the index: Parquet partitioned by ``run``, ``client_key`` and ``day``, rows sorted by ``date_ms``
inside each file so min/max statistics prune time ranges; Bloom filters on recipient, queue and message let a
look-up skip row groups that don't hold the value.  ``client_key`` is the client id behind a letter and a
dash: never empty, never a number or date, read with an explicit schema; ``client_id`` is taken from it, so
filters on the client prune folders.  The write is range-partitioned on (client_id, date_ms): a client
with a third of all records is spread over many tasks and files.  Records already stored (same ten
fields) are anti-joined away, reading only the clients' days that the batch touches.

Open queues (SNK-2): a run writes the changes of the queues that its lines touch, closed ones as such; every ``FOLD``
runs the sum is written as a snapshot instead.  What a run writes follows its lines, not the number of open queues.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..schema import DELIVERIES, DELIVERY_COLUMNS, OPEN_QUEUES, RECORD_KEY
from .commits import Log, read_log

LEDGER = "ingested_files"
FOLD = 16  # runs between snapshots of the open queues
LOOKED_UP = ("rcpt_email", "queue_id", "msg_id")


def committed_runs(spark: SparkSession, index_dir: str) -> list[int]:
    """Runs whose folders count, in the order of their commits."""
    return read_log(spark, index_dir).live


def next_run(spark: SparkSession, index_dir: str) -> int:
    """A number above those of all runs, also of those that failed."""
    seen = storage.runs(spark, f"{index_dir}/{LEDGER}") + storage.runs(spark, f"{index_dir}/deliveries") + committed_runs(spark, index_dir)
    return max([int(time.time() * 1000), *[r + 1 for r in seen]])


def _of_runs(spark: SparkSession, path: str, schema: str, runs: list[int]) -> DataFrame | None:
    """The folders of some runs of a table, and no others, listed; None if there are none."""
    have = set(storage.runs(spark, path))
    paths = [f"{path}/run={r}" for r in runs if r in have]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths) if paths else None


def read_table(spark: SparkSession, index_dir: str, name: str, schema, runs: list[int] | None = None) -> DataFrame:
    """A per-run table of an index, live runs only (or those given), with its column ``run``."""
    full = f"{schema if isinstance(schema, str) else ', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, run long"
    found = _of_runs(spark, f"{index_dir}/{name}", full, committed_runs(spark, index_dir) if runs is None else runs)
    return spark.createDataFrame([], full) if found is None else found


def write_table(df: DataFrame, index_dir: str, name: str, run: int) -> None:
    """A run's part of a table; written again, it replaces what an earlier attempt left."""
    df.write.mode("overwrite").parquet(f"{index_dir}/{name}/run={run}")


def write_deliveries(deliveries: DataFrame, path: str, partitions: int | None = None, staged: bool = False,
                     run: int | None = None, visible: list[int] | None = None) -> int:
    """SNK-1: add records to the index table at ``path`` with set semantics, as run ``run``.

    The batch is staged once in the shared checkpoint folder (``staged=True`` says the caller has done so); records
    already stored by ``visible`` runs (all by default) are anti-joined away, null-safe, reading only the
    (client, day) folders of the batch; the range exchange on (client_id, date_ms) both lays the files out and
    clusters duplicates, so de-duplication needs no shuffle of its own.  Returns the number of rows offered."""
    from ..session import checkpoint_dir
    from .pipeline import distinct_records

    spark = deliveries.sparkSession
    checkpoint_dir(spark)
    batch = deliveries if staged else deliveries.checkpoint(eager=True)
    offered = batch.count()
    if not offered:
        return 0
    seen = storage.runs(spark, path)
    run = run if run is not None else max([int(time.time() * 1000), *[r + 1 for r in seen]])
    new = batch
    others = [r for r in (seen if visible is None else visible) if r != run and r in seen]
    if others:
        touched = batch.select(_client_key().alias("client_key"), "day").distinct()
        stored = _stored(spark, path, others).join(touched, ["client_key", "day"], "left_semi").select(*RECORD_KEY)
        new = new.join(stored, [new[c].eqNullSafe(stored[c]) for c in RECORD_KEY], "left_anti")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_layout(distinct_records(new.repartitionByRange(n, "client_id", "date_ms")), f"{path}/run={run}")
    return offered


def write_layout(records: DataFrame, path: str) -> None:
    """Records, dealt by (client_id, date_ms), in the layout of the index."""
    writer = (records.withColumn("client_key", _client_key()).sortWithinPartitions("client_key", "day", "date_ms").drop("client_id")
              .write.mode("overwrite").partitionBy("client_key", "day").option("parquet.bloom.filter.adaptive.enabled", "true"))
    for c in LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def _client_key():
    return F.concat(F.lit("c-"), F.col("client_id"))


def _stored(spark: SparkSession, path: str, runs: list[int]) -> DataFrame:
    return _of_runs(spark, path, DELIVERIES, runs).withColumn("client_id", F.expr("substring(client_key, 3)"))


def read_deliveries(spark: SparkSession, path: str, runs: list[int] | None = None) -> DataFrame:
    """The index table at ``path``; all runs, or those given."""
    have = storage.runs(spark, path)
    runs = [r for r in (have if runs is None else runs) if r in set(have)]
    if not runs:
        return spark.createDataFrame([], DELIVERIES).withColumn("client_id", F.lit(None).cast("string")).select(*DELIVERY_COLUMNS)
    return _stored(spark, path, runs).select(*DELIVERY_COLUMNS)


def read_index(spark: SparkSession, index_dir: str) -> DataFrame:
    """The delivery records of an index's committed runs."""
    return read_deliveries(spark, f"{index_dir}/deliveries", committed_runs(spark, index_dir))


STATE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OPEN_QUEUES) + ", closed boolean"


def write_open_queues(open_queues: DataFrame, path: str, run: int) -> None:
    """SNK-2: a run's part of the open queues: all of them, or changes (``closed`` marks a queue that is open no more)."""
    closed: Column = F.col("closed") if "closed" in open_queues.columns else F.lit(False)
    open_queues.select(*OPEN_QUEUES.fieldNames(), closed.alias("closed")).write.mode("overwrite").parquet(f"{path}/run={run}")


def open_queue_changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """What happened to the queues that some lines touched: ``before`` and ``after`` are those of them that were, or are, open."""
    if before is None:
        return after.withColumn("closed", F.lit(False))
    was = before.select("queue_id", F.lit(True).alias("was"))
    return after.withColumn("open_", F.lit(True)).join(was, "queue_id", "full").withColumn("closed", F.col("open_").isNull()).drop("was", "open_")


def read_open_queues(spark: SparkSession, path: str, runs: list[int] | None = None, log: Log | None = None) -> DataFrame | None:
    """The open queues after the last commit (``path`` is the table's folder in an index), or as ``log`` has them.

    The last snapshot and the changes after it, at most ``FOLD`` folders; of each queue the latest row counts."""
    log = log or read_log(spark, path.rsplit("/", 1)[0])
    if not log.state:
        return None
    parts = [spark.read.schema(STATE).parquet(f"{path}/run={r}").withColumn("at_", F.lit(i)) for i, r in enumerate(log.state)]
    if len(parts) == 1:
        return parts[0].where("NOT closed").drop("at_", "closed")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    last = every.groupBy("queue_id").agg(F.max_by(F.struct(*OPEN_QUEUES.fieldNames(), "closed"), "at_").alias("q"))
    return last.where("NOT q.closed").select("q.*").drop("closed")


def to_json_rows(df: DataFrame) -> DataFrame:
    """SNK-3: one JSON object per row (NULL fields written as null)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
