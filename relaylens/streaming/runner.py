"""Run the streaming job to completion over lines that are already known.

Used by the tests and by the registered stream queries: the lines are landed as text chunks (names sort in
line order), the stream runs with ``availableNow`` into an index, and the index is read.  Restarting with the same
checkpoint continues where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..plans.sink import read_index
from .stream import start_index_stream, stream_mail_logs


def land_chunks(raw_lines: DataFrame, landing_dir: str, chunks: int | None = None) -> None:
    """Write ``raw_lines`` as text chunks whose names and modification times follow the line order.

    They are written side by side and then moved into ``landing_dir`` one after the other, as a shipper would land them."""
    spark = raw_lines.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [(-F.col("rotation")).alias("_r"), "file", "block_start", "line_seq"]
    ordered = raw_lines.select(*order, "line")
    aside = f"{landing_dir.rstrip('/')}-{uuid.uuid4().hex}"
    (ordered.repartitionByRange(n, "_r", "file", "block_start", "line_seq")
        .sortWithinPartitions("_r", "file", "block_start", "line_seq")
        .select("line").write.text(aside))
    have = len(storage.names(spark, landing_dir))
    parts = [x for x in storage.names(spark, aside) if x.startswith("part-")]
    for k, part in enumerate(parts, start=have):
        storage.move(spark, f"{aside}/{part}", f"{landing_dir}/chunk-{k:06d}", 1_700_000_000_000 + 1000 * k)
    storage.delete(spark, aside)


def run_landed_stream(spark: SparkSession, base: str, rules: DataFrame, max_files_per_trigger: int | None = None,
                      ttl_ms: int | None = None) -> DataFrame:
    """Run the stream over ``base/landing`` into ``base/index`` until no input is left."""
    q = start_index_stream(stream_mail_logs(spark, f"{base}/landing", max_files_per_trigger), rules, f"{base}/index",
                           f"{base}/checkpoint", ttl_ms=ttl_ms, trigger={"availableNow": True})
    q.awaitTermination()
    return read_index(spark, f"{base}/index")
