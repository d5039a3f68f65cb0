"""Per-client queries over delivery records (QRY-1..16).

Results are flat DataFrames: a "map of key -> sorted records" is the records
with a ``group_key`` column, sorted by (key, date); a two-level map adds
``sub_key``.  First/last per key is a partial aggregation (``min_by`` /
``max_by``), so a hot key is pre-aggregated on the map side; plain listings
sort globally (range-partitioned, so a hot client is spread over tasks).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

# Query property names -> record columns (fixed by the client API)
GROUP_PROPERTIES = {"rcptEmail": "rcpt_email", "queueId": "queue_id", "msgId": "msg_id"}

RECORD_FIELDS = [
    "client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email",
    "status", "info", "state", "state_info",
]

DAY_MS = 86_400_000


def tie_break() -> Column:
    """Order of two records of the same millisecond: their text form."""
    parts = ["queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info", "state", "state_info"]
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parts])


def record_order(descending: bool = False) -> list[Column]:
    if descending:
        return [F.col("date_ms").desc(), tie_break().desc()]
    return [F.col("date_ms").asc(), tie_break().asc()]


def group_columns(group_by) -> list[str]:
    """'rcptEmail' -> [rcpt_email]; 'A-and-B' or (A, B) -> [B, A].

    In a two-level grouping the *second* property keys the outer level."""
    if group_by is None:
        return []
    if isinstance(group_by, str) and "-and-" in group_by:
        group_by = tuple(group_by.split("-and-", 1))
    names = [group_by] if isinstance(group_by, str) else list(group_by)
    bad = [n for n in names if n not in GROUP_PROPERTIES]
    if bad or len(names) not in (1, 2):
        raise ValueError(f"unknown group property {bad or names}; use one of {sorted(GROUP_PROPERTIES)}")
    cols = [GROUP_PROPERTIES[n] for n in names]
    return cols[::-1]


def time_bounds(df: DataFrame, from_ms=None, to_ms=None, column: str = "date_ms") -> DataFrame:
    """Inclusive [from_ms, to_ms]; also bounds ``day`` when present so that
    day-partitioned tables are pruned."""
    has_day = "day" in df.columns
    if from_ms is not None:
        df = df.where(F.col(column) >= F.lit(int(from_ms)))
        if has_day:
            df = df.where(F.col("day") >= F.date_from_unix_date(F.lit(int(from_ms) // DAY_MS)))
    if to_ms is not None:
        df = df.where(F.col(column) <= F.lit(int(to_ms)))
        if has_day:
            df = df.where(F.col("day") <= F.date_from_unix_date(F.lit(int(to_ms) // DAY_MS)))
    return df


def filter_records(df: DataFrame, client_id: str, rcpt_email=None, queue_id=None, msg_id=None,
                   from_ms=None, to_ms=None, include_ok: bool = False) -> DataFrame:
    """QRY-1..6: client (mandatory), equality filters, OK hidden, time range."""
    q = df.where(F.col("client_id") == F.lit(client_id))
    for col, val in (("rcpt_email", rcpt_email), ("queue_id", queue_id), ("msg_id", msg_id)):
        if val is not None:
            q = q.where(F.col(col) == F.lit(val))
    if not include_ok:
        q = q.where(F.col("state") != F.lit(P.STATE_OK))
    return time_bounds(q, from_ms, to_ms)


def _shape(q: DataFrame, keys: list[str], last, descending: bool, sort: bool,
           extra: list[str] | None = None) -> DataFrame:
    """Apply grouping / first-last to filtered records."""
    extra = extra or []
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, ["group_key", "sub_key"])]
    if last is None:
        out = q.select(*extra, *key_cols, *RECORD_FIELDS)
        if sort:
            out = out.orderBy(*[F.col(c) for c in extra + ["group_key", "sub_key"][:len(keys)]],
                              *record_order(descending))
        return out
    order = F.struct(F.col("date_ms"), tie_break())
    rec = F.struct(*RECORD_FIELDS)
    if not keys and not extra:
        # QRY-9: one record overall -> TakeOrderedAndProject
        return q.select(*RECORD_FIELDS).orderBy(*record_order(descending=bool(last))).limit(1)
    grouped = q.select(*extra, *key_cols, rec.alias("_r"), order.alias("_o")).groupBy(
        *extra, *["group_key", "sub_key"][:len(keys)])
    agg = grouped.agg((F.max_by("_r", "_o") if last else F.min_by("_r", "_o")).alias("_r"))
    out = agg.select(*extra, *["group_key", "sub_key"][:len(keys)], "_r.*")
    if sort:
        out = out.orderBy(*extra, *["group_key", "sub_key"][:len(keys)])
    return out


def query_deliveries(df: DataFrame, client_id: str, rcpt_email=None, queue_id=None, msg_id=None,
                     from_ms=None, to_ms=None, last=None, group_by=None, include_ok: bool = False,
                     descending: bool = False, sort: bool = True) -> DataFrame:
    """One client's records, filtered, optionally grouped and/or reduced to the
    first (``last=False``) or last (``last=True``) record (per group)."""
    keys = group_columns(group_by)
    q = filter_records(df, client_id, rcpt_email, queue_id, msg_id, from_ms, to_ms, include_ok)
    return _shape(q, keys, last, descending, sort)


def slice_count(from_ms: int, to_ms: int, step_ms: int) -> int:
    """Number of slices [from, from+step], ..., [.., to] (the last may be short)."""
    if step_ms <= 0:
        raise ValueError("step_ms must be positive")
    if to_ms <= from_ms:
        return 0
    return -(-(to_ms - from_ms) // step_ms)


def query_slices(df: DataFrame, client_id: str, from_ms: int, to_ms: int | None, step_ms: int,
                 boundary: str = "inclusive", rcpt_email=None, queue_id=None, msg_id=None,
                 last=None, group_by=None, include_ok: bool = False, sort: bool = True) -> DataFrame:
    """QRY-15/16: the same query over consecutive time slices, as one job with one scan.

    Every slice gets at least one row (``date_ms`` NULL when it is empty).
    ``boundary='inclusive'`` puts a record lying exactly on an inner border in
    both neighbouring slices (as the batch client does); ``'half_open'`` only
    in the later one."""
    if boundary not in ("inclusive", "half_open"):
        raise ValueError("boundary must be 'inclusive' or 'half_open'")
    if to_ms is None:
        to_ms = int(time.time() * 1000)
    n = slice_count(int(from_ms), int(to_ms), int(step_ms))
    spark = df.sparkSession
    frm, to, step = F.lit(int(from_ms)), F.lit(int(to_ms)), F.lit(int(step_ms))
    keys = group_columns(group_by)
    q = filter_records(df, client_id, rcpt_email, queue_id, msg_id, from_ms, to_ms, include_ok)
    k = F.floor((F.col("date_ms") - frm) / step).cast("long")
    lo = frm + F.col("_c") * step
    hi = F.least(frm + (F.col("_c") + 1) * step, to)
    in_slice = (F.col("_c") >= 0) & (F.col("_c") < n) & (F.col("date_ms") >= lo)
    if boundary == "inclusive":
        in_slice = in_slice & (F.col("date_ms") <= hi)
    else:
        in_slice = in_slice & ((F.col("date_ms") < hi) | ((F.col("_c") == n - 1) & (F.col("date_ms") == to)))
    # only a record on an inner border, or on the end of the last slice, can be in the slice before, too
    on_border = (F.col("date_ms") - frm) % step == 0
    last_end = F.col("date_ms") == to
    tagged = (q.withColumn("_c", F.explode(F.when(on_border | last_end, F.array(k - 1, k)).otherwise(F.array(k))))
              .where(in_slice).withColumnRenamed("_c", "slice_id"))
    # dealt once: records and the list of slices that have any read the same exchange, so the input is scanned once
    tagged = tagged.select("slice_id", *RECORD_FIELDS).repartition("slice_id", "queue_id")
    shaped = _shape(tagged, keys, last, False, sort=False, extra=["slice_id"])
    # slices are numbered by the driver's parameters; bounds are arithmetic,
    # so records are never joined to the slice table
    slices = spark.range(n).select(F.col("id").alias("slice_id"))
    # all columns are named, or column pruning would make it another exchange
    present = tagged.groupBy("slice_id").agg(F.bit_xor(F.xxhash64(*tagged.columns)).alias("_n")).where("_n IS NOT NULL").drop("_n")
    empty = slices.join(present, "slice_id", "left_anti")
    filled = shaped.unionByName(empty, allowMissingColumns=True)
    out = filled.select(
        "*",
        (frm + F.col("slice_id") * step).alias("slice_from"),
        F.least(frm + (F.col("slice_id") + 1) * step, to).alias("slice_to"),
    )
    cols = ["slice_id", "slice_from", "slice_to"] + [c for c in shaped.columns if c != "slice_id"]
    out = out.select(*cols)
    if sort:
        out = out.orderBy("slice_id", *[c for c in ("group_key", "sub_key") if c in cols], *record_order())
    return out
