"""Status aggregates over all records of all clients (AGG-1..7).

All are partial aggregations (map-side combine) or distincts; none gathers a
client's records into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .query import RECORD_FIELDS, record_order, tie_break, time_bounds


def recipient_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """AGG-1: distinct recipients per client (NULL recipients not counted)."""
    cnt = F.approx_count_distinct("rcpt_email") if approx else F.count_distinct("rcpt_email")
    return df.groupBy("client_id").agg(cnt.cast("long").alias("recipients"))


# distinct recipients as HyperLogLog sketches, a row per run, client and day
SKETCHES = "client_id string, day date, recipients binary"
SKETCH_BITS = 12  # 4096 registers: a standard error of 1.04 / sqrt(4096), 1.6 %


def recipient_sketches(df: DataFrame) -> DataFrame:
    """Sketches of the recipients of records, by client and day; they merge without the records."""
    return df.groupBy("client_id", "day").agg(F.hll_sketch_agg("rcpt_email", F.lit(SKETCH_BITS)).alias("recipients"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("client_id", "day").agg(F.hll_union_agg("recipients").alias("recipients"))


def estimated_recipients(sketches: DataFrame, from_day=None, to_day=None) -> DataFrame:
    """AGG-1 from sketches, for days from ``from_day`` to ``to_day`` (both included): no record is read.

    Exact up to some hundred recipients, else within the sketch's error; a client without recipients has 0."""
    if from_day is not None:
        sketches = sketches.where(F.col("day") >= F.lit(from_day).cast("date"))
    if to_day is not None:
        sketches = sketches.where(F.col("day") <= F.lit(to_day).cast("date"))
    return sketches.groupBy("client_id").agg(F.hll_sketch_estimate(F.hll_union_agg("recipients")).alias("recipients"))


def recipients(df: DataFrame) -> DataFrame:
    """AGG-2: the distinct recipients of every client."""
    return df.select("client_id", "rcpt_email").distinct()


def unknown_bounces(df: DataFrame) -> DataFrame:
    """AGG-3: records no rule could classify (state 2), per client.

    A client without any still appears, once, with NULL record fields."""
    unknown = df.where(F.col("state") == P.STATE_UNKNOWN).select(*RECORD_FIELDS)
    none = (df.groupBy("client_id")
            .agg(F.max((F.col("state") == P.STATE_UNKNOWN).cast("int")).alias("_any"))
            .where(F.col("_any") == 0).select("client_id"))
    return unknown.unionByName(none, allowMissingColumns=True)


def index_age(df: DataFrame) -> DataFrame:
    """AGG-4: date of the first stored record, now if there is none.

    Storage is ordered by client first, so that is the oldest record of the
    alphabetically first client (``index_age_ms``); ``oldest_ms`` is the true
    minimum over all clients."""
    now = F.unix_millis(F.current_timestamp())
    return df.agg(
        F.coalesce(F.min_by("date_ms", F.struct("client_id", "date_ms")), now).alias("index_age_ms"),
        F.coalesce(F.min("date_ms"), now).alias("oldest_ms"),
    )


def client_ids(df: DataFrame) -> DataFrame:
    """AGG-5: distinct clients, sorted."""
    return df.select("client_id").distinct().orderBy("client_id")


def records_by_client(df: DataFrame, from_ms=None, to_ms=None, sort: bool = True) -> DataFrame:
    """AGG-6: every record (OK included) of every client inside the interval."""
    out = time_bounds(df, from_ms, to_ms).select(*RECORD_FIELDS)
    if sort:
        out = out.orderBy("client_id", *record_order())
    return out


def client_record_counts(df: DataFrame, from_ms=None, to_ms=None) -> DataFrame:
    """AGG-6: number of records per client inside the interval."""
    return time_bounds(df, from_ms, to_ms).groupBy("client_id").agg(F.count("*").alias("records"))


__all__ = [
    "recipient_counts", "recipient_sketches", "merged_sketches", "estimated_recipients", "recipients", "unknown_bounces", "index_age", "client_ids",
    "records_by_client", "client_record_counts", "tie_break",
]
