"""Structured Streaming (STR-1..5): landed log chunks -> the delivery index.

A log shipper lands immutable chunks of the live log in a directory, named so that their names sort in writing
order.  Each micro-batch is one run of the index (``foreachBatch``): its lines go through the same plans as a
batch run -- parse, the split-wise lifecycle scan, classification, set semantics -- seeded with the open queues of the
last committed run, so no Python walks lines and a queue with a third of them spreads over many tasks.  The run's
number follows the epoch: a replayed micro-batch writes the same run again, or finds it committed.  The
open queues are the state; backfill and stream share them, the ledger and the index.

Lines keep their order: by chunk name, split and position.  The file source picks chunks by modification time; a chunk whose name
sorts before one of an earlier micro-batch is still taken in and reported in the diagnostics.

A queue stays open until its ``removed`` line, as in the original agent; with ``ttl_ms`` it expires when the log time, carried
on from run to run, is that much past its last line (``operators.lifecycle``).  ``on_batch`` gets each run's counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..plans.commits import read_log
from ..plans.index_job import process_lines
from ..plans.sink import next_run
from ..sources.logfiles import BLOCK_LINES
from ..sources.prefixes import staged


def stream_mail_logs(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-1: streaming lines of landed chunks with their place."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(landing_dir).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line"))


def batch_lines(batch: DataFrame) -> DataFrame:
    """A micro-batch as ``raw_lines``: all chunks have rotation 0, so their names give the order."""
    place = F.monotonically_increasing_id()
    return batch.select("file", F.lit(0).alias("rotation"),
                        (F.col("block_start") + F.floor(F.pmod(place, F.lit(1 << 33)) / BLOCK_LINES)).alias("block_start"),
                        place.alias("line_seq"), "line")


def start_index_stream(lines: DataFrame, rules: DataFrame, index_dir: str, checkpoint_location: str,
                       time_zone: str = "UTC", ttl_ms: int | None = None, trigger: dict | None = None, on_batch=None):
    """Run the live path into the index that the batch job writes, from its last committed run on (STR-5).

    The first micro-batch's run number is kept next to the stream's checkpoint; later ones count on from it."""
    spark = lines.sparkSession
    start_at = f"{checkpoint_location.rstrip('/')}-first-run"
    if storage.exists(spark, f"{start_at}/_SUCCESS"):
        first = spark.read.schema("run long").parquet(start_at).head().run
    else:
        first = next_run(spark, index_dir)
        spark.createDataFrame([(first,)], "run long").coalesce(1).write.mode("overwrite").parquet(start_at)

    def take_in(batch: DataFrame, epoch: int) -> None:
        run = first + epoch
        log = read_log(spark, index_dir)
        if log.knows(run) or batch.isEmpty():
            return
        with storage.Scratch(spark) as scratch:
            # the chunks are read once
            kept = scratch.keep(staged(batch_lines(batch)))
            mark = F.xxhash64("block_start", "line_seq", "line_hash").cast("decimal(38,0)")
            chunks = scratch.keep(kept.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(mark).cast("string").alias("fingerprint")))
            names = chunks.agg(F.min("file"), F.max("file")).head()
            earlier = _last_chunk(spark, index_dir)
            notes = [f"chunk {names[0]} came after {earlier}"] if earlier is not None and names[0] < earlier else []
            # a chunk's first line, size and last bytes are not looked at: chunks are known by the stream's checkpoint
            none = {"digest": "string", "size_bytes": "long", "tail": "string", "modified": "timestamp"}
            ledger = chunks.select("file", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(False).alias("held"),
                                   "lines", "fingerprint", F.col("lines").alias("taken"))
            counters = process_lines(spark, kept, index_dir, run, rules, ledger, time_zone, notes=notes, ttl_ms=ttl_ms)
        if on_batch:
            on_batch(run, counters)

    return (lines.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint_location)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


def _last_chunk(spark: SparkSession, index_dir: str) -> str | None:
    """The greatest chunk name of the stream's runs so far."""
    from ..plans.index_job import read_ledger

    return read_ledger(spark, index_dir).where("digest is null").agg(F.max("file")).head()[0]
