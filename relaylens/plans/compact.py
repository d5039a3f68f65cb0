"""Compaction of an index: folders of many runs become folders of few (SNK-1).

Runs are sorted into tiers by the size of their records, each tier ``FAN`` times as large as the one before; a tier with ``FAN``
runs or more is merged into one run of a higher tier.  So there are at most ``FAN`` live runs a tier, a number that
grows with the logarithm of the index, and a record is rewritten once a tier.  Merged folders have the layout of the index:
client and day folders, range-partitioned and sorted, in files of about ``FILE_BYTES``.

The merged run's folders are written first; one commit lets them take the place of the runs they hold.  A crash before
it leaves folders that no reader lists, one after it leaves replaced folders that the next ``vacuum``
deletes.  ``compact_index`` deletes what earlier compactions replaced, not what it replaces itself, so that readers that are
under way find their files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators.status import SKETCHES, merged_sketches
from ..schema import INGESTED_FILES, SKIPPED_FILES
from ..sources.prefixes import FILE_CHAINS
from .commits import commit, read_log
from .index_job import DIAGNOSTICS, REJECTED, RULE_HITS, STATS
from .sink import LEDGER, next_run, read_deliveries, read_table, write_layout, write_table

FAN = 8
SMALL = 64 << 20  # bytes of the lowest tier's runs
FILE_BYTES = 128 << 20

# tables of a run besides its records; rows of rule_hits add up, rows of the chains are a set
TABLES = {"rule_hits": RULE_HITS, "diagnostics": DIAGNOSTICS, "rejected_lines": REJECTED, "ingest_stats": STATS,
          "skipped_files": SKIPPED_FILES, "file_chains": FILE_CHAINS, "recipient_sketches": SKETCHES, LEDGER: INGESTED_FILES}


def tiers(sizes: dict[int, int], fan: int = FAN, small: int = SMALL) -> list[list[int]]:
    """Groups of runs to merge: all runs of each tier that has ``fan`` or more."""
    by: dict[int, list[int]] = {}
    for run, size in sizes.items():
        tier, bound = 0, small
        while size >= bound:
            tier, bound = tier + 1, bound * fan
        by.setdefault(tier, []).append(run)
    return [runs for _, runs in sorted(by.items()) if len(runs) >= fan]


def merge_runs(spark: SparkSession, index_dir: str, runs: list[int], file_bytes: int = FILE_BYTES) -> int:
    """One run in the place of ``runs``; returns its number."""
    log, run = read_log(spark, index_dir), next_run(spark, index_dir)
    size = sum(storage.size(spark, f"{index_dir}/deliveries/run={r}") for r in runs)
    records = read_deliveries(spark, f"{index_dir}/deliveries", runs)
    if size:
        write_layout(records.repartitionByRange(max(1, -(-size // file_bytes)), "client_id", "date_ms"), f"{index_dir}/deliveries/run={run}")
    for name, schema in TABLES.items():
        rows = read_table(spark, index_dir, name, schema, runs).drop("run")
        if name == "rule_hits":
            rows = rows.groupBy("rule_id").agg(F.sum("hits").alias("hits"))
        elif name == "file_chains":
            rows = rows.distinct()
        elif name == "recipient_sketches":
            rows = merged_sketches(rows)
        bytes_ = sum(storage.size(spark, f"{index_dir}/{name}/run={r}") for r in runs)
        write_table(rows.repartition(max(1, -(-bytes_ // file_bytes))), index_dir, name, run)
    commit(spark, index_dir, log, run, drops=runs)
    return run


def compact_index(spark: SparkSession, index_dir: str, fan: int = FAN, small: int = SMALL) -> list[int]:
    """Merges every tier that is full; returns the numbers of the new runs."""
    vacuum(spark, index_dir)
    done = []
    while True:
        live = read_log(spark, index_dir).live
        full = tiers({r: storage.size(spark, f"{index_dir}/deliveries/run={r}") for r in live}, fan, small)
        if not full:
            return done
        done.append(merge_runs(spark, index_dir, full[0]))


def vacuum(spark: SparkSession, index_dir: str) -> None:
    """Deletes folders that compactions replaced, and open queues before the last snapshot.

    Folders of runs that were never committed stay: such a run may be under way."""
    log = read_log(spark, index_dir)
    for name in ("deliveries", *TABLES):
        for run in storage.runs(spark, f"{index_dir}/{name}"):
            if log.knows(run) and run not in log.live:
                storage.delete(spark, f"{index_dir}/{name}/run={run}")
    for run in storage.runs(spark, f"{index_dir}/open_queues"):
        if log.knows(run) and run not in log.state:
            storage.delete(spark, f"{index_dir}/open_queues/run={run}")
