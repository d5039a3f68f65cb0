"""End-to-end batch plans: raw lines -> classified, de-duplicated deliveries.

``build_deliveries`` is the whole indexing job as one lazy DataFrame plan:
scan + parse (one code-generated stage, unmatched lines dropped), one hash
exchange on (queue, split) for the lifecycle windows, a small exchange for the
split summaries, classification in the same stage, and one exchange for the
set semantics of the index.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..operators.lifecycle import correlate
from ..operators.parse import parse_lines
from ..operators.query import DAY_MS
from ..schema import DEDUP_ORDER


class Index(NamedTuple):
    deliveries: DataFrame
    open_queues: DataFrame
    traced: DataFrame


def to_delivery_rows(classified: DataFrame) -> DataFrame:
    """Final ``deliveries`` layout with the derived ``date`` and ``day``."""
    return classified.select(
        "client_id", "date_ms", F.timestamp_millis("date_ms").alias("date"),
        "queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info",
        F.col("state").cast("int").alias("state"), "state_info",
        F.date_from_unix_date(F.floor(F.col("date_ms") / DAY_MS).cast("int")).alias("day"),
        "source_file",
    )


def distinct_records(deliveries: DataFrame) -> DataFrame:
    """Set semantics of the index: one row per distinct record (the ten
    record fields); other columns are taken from any one duplicate."""
    others = [c for c in deliveries.columns if c not in DEDUP_ORDER]
    return (deliveries.groupBy(*DEDUP_ORDER).agg(*[F.first(c).alias(c) for c in others])
            .select(*deliveries.columns))


def build_deliveries(raw_lines: DataFrame, rules: DataFrame, open_queues_seed: DataFrame | None = None,
                     time_zone: str = "UTC", hits: DataFrame | None = None, dedup: bool = True,
                     materialize: str | None = None) -> Index:
    parsed = parse_lines(raw_lines, time_zone)
    corr = correlate(parsed, open_queues_seed, materialize)
    deliveries = to_delivery_rows(classify(corr.records, rules, hits))
    if dedup:
        deliveries = distinct_records(deliveries)
    return Index(deliveries, corr.open_queues, corr.traced)
