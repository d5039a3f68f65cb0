"""Queue-lifecycle correlation (LIFE-1..5) as a two-level scan.

Per queue id the original agent runs a tiny automaton over the lines in file
order: a message-id line opens (or overwrites) an entry, a client-id line
names the client, attempts are emitted while the entry lives and the client is
known, an attempt or expiry of an unknown client drops the entry, ``removed``
drops it.  Every quantity the automaton needs is a prefix aggregate ("first
non-null since the entry was opened", "any deferral before this line", ...)
over the queue's lines, so it is computed with window functions -- but never
with one window over a whole queue, because a single queue id may hold a huge
share of all lines:

1. rows are windowed per ``(queue_id, chunk)``, a chunk being one input split
   ``(file, block_start)`` -- bounded by the split size whatever the skew;
2. each chunk of a queue is summarised into one row (the state its last
   segment hands on);
3. the summaries -- at most one per queue and split -- are folded in file
   order with windows, giving every chunk the state carried in from before;
4. the carried state is joined back onto the rows of the chunk's first
   segment (the rows before its first message-id line).

Line order is ``(rotation desc, file, block_start, line_seq)``; timestamps are
never used for ordering (they go backwards in real logs).

A time to live (``ttl_ms``) drops an entry before a line at which the log time, the
latest date of any line so far in file order, is that much past the date of the queue's
line before.  Both depend on the lines and their order only, so a replay, a backfill and a stream in
any micro-batches expire the same queues at the same lines.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

_CHUNK = ["queue_id", "file", "block_start"]
_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing

# Summary columns handed from one chunk to the next
_CARRY = ["exists", "msg_id", "cid", "def", "drcpt", "dead"]


def with_log_time(parsed: DataFrame, start_ms: int | None = None) -> DataFrame:
    """``parsed`` (with ``line_ms``) and ``log_ms``, the latest date of all lines up to each; ``start_ms`` is that of earlier runs.

    Latest dates of blocks are carried on in file order -- a row per input split -- and followed by line inside a block."""
    place = ["file", "block_start"]
    blocks = parsed.groupBy("rotation", *place).agg(F.max("line_ms").alias("top"))
    earlier = Window.orderBy(F.col("rotation").desc(), *place).rowsBetween(_UNB, -1)
    start = F.lit(start_ms).cast("long")
    blocks = blocks.select(*place, F.greatest(F.max("top").over(earlier), start).alias("before"))
    inside = Window.partitionBy(*place).orderBy("line_seq").rowsBetween(_UNB, 0)
    out = parsed.join(blocks, place)
    out = out.withColumn("log_ms", F.greatest("before", F.max("line_ms").over(inside))).drop("before")
    return out.withColumn("line_ms", F.coalesce("line_ms", "log_ms"))


def _row_windows(parsed: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    k = F.col("kind")
    dated = "line_ms" in parsed.columns
    if not dated:
        parsed = parsed.withColumn("line_ms", F.lit(None).cast("long"))
    timed = ["log_ms"] if ttl_ms is not None else []
    # hash layout on the split key (spark.sql.shuffle.partitions buckets, which
    # AQE may pack into fewer tasks for small inputs): the windows, the split
    # summaries and the bucketed row table all follow it
    rows = parsed.select(
        "queue_id", "file", "rotation", "block_start", "line_seq", "kind", "event_ms",
        "rcpt_email", "sender_email", "status", "info", "msg_id", "client_id", "line_ms", *timed,
    ).where(F.col("queue_id").isNotNull()).repartition(*_CHUNK)
    rows = rows.select(
        "*",
        (k == "M").alias("is_m"),
        (k == "C").alias("is_c"),
        (k == "R").alias("is_r"),
        k.isin("A", "E").alias("is_ae"),
        ((k == "A") & (F.col("status") == "deferred")).alias("is_def"),
        F.when(k.isin("M", "C"), F.col("client_id")).alias("cid_val"),
    )
    # Every window has one partition and one order, so a split is sorted once.  A segment (a message-id line and what
    # follows it) is no partition of its own: what a line knows of its segment carries the segment's number, ``life``, and
    # the greatest pair of a segment and a place counted backwards is the segment's first.
    w_chunk = Window.partitionBy(*_CHUNK).orderBy("line_seq")
    upto, before = w_chunk.rowsBetween(_UNB, 0), w_chunk.rowsBetween(_UNB, -1)
    rows = rows.select(
        "*",
        F.sum(F.col("is_m").cast("int")).over(upto).alias("local_life"),
        F.row_number().over(w_chunk).alias("place"),
        F.lead(F.lit(True)).over(w_chunk).isNull().alias("is_last"),
    )
    if ttl_ms is not None:
        late = F.col("log_ms") - F.last("line_ms", ignorenulls=True).over(before) > ttl_ms
        rows = rows.select("*", F.coalesce(late, F.lit(False)).alias("late"),
                           F.min("log_ms").over(w_chunk.rowsBetween(_UNB, _UNF)).alias("chunk_log_ms"))
    life = F.col("local_life")

    def first(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct(life.alias("life"), (-F.col("place")).alias("back"), value.alias("v")))).over(before)

    def last_life(cond: Column) -> Column:
        return F.max(F.when(cond, life))

    def mine(found: str) -> Column:
        return F.when(F.col(f"{found}.life") == life, F.col(f"{found}.v"))

    rows = rows.select(
        "*",
        F.max(F.when(F.col("is_m"), F.struct(life.alias("life"), F.col("msg_id").alias("v")))).over(upto).alias("_msg"),
        first(F.col("cid_val")).alias("_cid"),
        first(F.when(F.col("is_def"), F.col("rcpt_email"))).alias("_drcpt"),
        last_life(F.col("is_def")).over(before).alias("_def"),
        last_life(F.col("is_r")).over(before).alias("_r"),
        # an entry that expires before this line or one before it is gone; a message-id line opens a new one
        *([last_life(F.col("late") & ~F.col("is_m")).over(upto).alias("_expired")] if ttl_ms is not None else []),
        (F.max(F.when(F.col("line_ms").isNotNull(), F.struct(life.alias("life"), F.col("place").alias("back"), F.col("line_ms").alias("v"))))
         .over(upto) if dated else F.lit(None).cast("struct<life: bigint, back: int, v: bigint>")).alias("_ms"),
    )
    rows = rows.withColumns({
        "seg_msg_id": mine("_msg"),
        "loc_cid_before": mine("_cid"),
        "loc_cid_at": F.coalesce(mine("_cid"), F.col("cid_val")),
        "loc_def_before": F.coalesce(F.col("_def") == life, F.lit(False)),
        "loc_drcpt_before": mine("_drcpt"),
        "loc_r_before": F.coalesce(F.col("_r") == life, F.lit(False)),
        "seg_last_ms": mine("_ms"),
    })
    dead_nocid = F.col("is_r") | (F.col("is_ae") & F.col("loc_cid_at").isNull())
    rows = rows.withColumn("loc_deadnc_before", F.coalesce(last_life(dead_nocid).over(before) == life, F.lit(False)))
    if ttl_ms is not None:
        expired = F.coalesce(F.col("_expired") == life, F.lit(False))
        rows = rows.withColumns({"loc_r_before": F.col("loc_r_before") | expired, "loc_deadnc_before": F.col("loc_deadnc_before") | expired,
                                 "expires": F.col("late") & ~F.col("is_m")})
    return rows.drop("_msg", "_cid", "_drcpt", "_def", "_r", "_expired", "_ms", "place")


def _chunk_summaries(rows: DataFrame) -> DataFrame:
    """One row per (queue, chunk): what the chunk's last segment hands on, as its last line knows it."""
    ae_first = F.col("is_ae") & F.col("loc_cid_at").isNull()
    return rows.where("is_last").select(
        *_CHUNK, (-F.col("rotation").cast("long")).alias("neg_rot"),
        (F.col("local_life") > 0).alias("has_m"),
        F.col("seg_msg_id").alias("s_msg_id"),
        F.col("loc_cid_at").alias("s_cid"),
        (F.col("loc_def_before") | F.coalesce(F.col("is_def"), F.lit(False))).alias("s_def"),
        F.coalesce("loc_drcpt_before", F.when(F.col("is_def"), F.col("rcpt_email"))).alias("s_drcpt"),
        (F.col("loc_r_before") | F.col("is_r")).alias("s_any_r"),
        # whether an attempt without a client ended the entry; counts only where nothing else did (``s_any_r``)
        (F.col("loc_deadnc_before") | ae_first).alias("s_ae_first"),
        F.col("seg_last_ms").alias("last_ms"),
        (F.col("chunk_log_ms") if "chunk_log_ms" in rows.columns else F.lit(None).cast("long")).alias("first_log_ms"),
    )


def _seed_summaries(open_queues: DataFrame) -> DataFrame:
    """Open queues of an earlier run act as a chunk before all files."""
    return open_queues.select(
        "queue_id", F.lit("").alias("file"), F.lit(-1).cast("long").alias("block_start"),
        F.lit(-(2 ** 63)).cast("long").alias("neg_rot"), F.lit(True).alias("has_m"),
        F.col("msg_id").alias("s_msg_id"), F.col("client_id").alias("s_cid"),
        F.coalesce(F.col("has_been_deferred"), F.lit(False)).alias("s_def"),
        F.col("rcpt_email").alias("s_drcpt"), F.lit(False).alias("s_any_r"),
        F.lit(False).alias("s_ae_first"),
        (F.col("last_ms") if "last_ms" in open_queues.columns else F.lit(None).cast("long")).alias("last_ms"),
        F.lit(None).cast("long").alias("first_log_ms"),
    )


def _fold_summaries(summ: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """End state after each chunk and the state carried into it."""
    order = ["neg_rot", "file", "block_start"]
    w_q = Window.partitionBy("queue_id").orderBy(*order)
    summ = summ.withColumn("seg", F.sum(F.col("has_m").cast("int")).over(w_q.rowsBetween(_UNB, 0)))
    w_s = Window.partitionBy("queue_id", "seg").orderBy(*order)
    upto = w_s.rowsBetween(_UNB, 0)
    summ = summ.select(
        "*",
        (F.col("seg") > 0).alias("e_exists"),
        F.first("s_msg_id", ignorenulls=True).over(upto).alias("e_msg_id"),
        F.first("s_cid", ignorenulls=True).over(upto).alias("e_cid"),
        F.first("s_cid", ignorenulls=True).over(w_s.rowsBetween(_UNB, -1)).alias("cid_before"),
        F.max("s_def").over(upto).alias("e_def"),
        F.first("s_drcpt", ignorenulls=True).over(upto).alias("e_drcpt"),
        F.last("last_ms", ignorenulls=True).over(w_q.rowsBetween(_UNB, 0)).alias("e_last_ms"),
        F.last("last_ms", ignorenulls=True).over(w_q.rowsBetween(_UNB, -1)).alias("last_ms_before"),
    )
    dead_val = F.col("s_any_r") | (F.col("cid_before").isNull() & F.col("s_ae_first"))
    expired = F.lit(False)
    if ttl_ms is not None:
        # what is carried into the chunk has expired before its first line
        expired = F.coalesce(F.col("first_log_ms") - F.col("last_ms_before") > ttl_ms, F.lit(False))
        dead_val = dead_val | (expired & ~F.col("has_m"))
    summ = summ.withColumn("e_dead", F.max(dead_val).over(upto))
    carried = {c: F.lag(f"e_{c}").over(w_q) for c in _CARRY}
    if ttl_ms is not None:
        carried["dead"] = carried["dead"] | expired
    return summ.select("*", *[v.alias(f"c_{c}") for c, v in carried.items()])


def _traced(rows: DataFrame, folded: DataFrame) -> DataFrame:
    # only splits into which an entry was carried need the join
    carry = folded.where((F.col("block_start") >= 0) & F.col("c_exists")).select(
        *_CHUNK, *[f"c_{c}" for c in _CARRY])
    t = rows.join(carry, on=_CHUNK, how="left")
    loc0 = F.col("local_life") == 0
    c_exists = F.coalesce(F.col("c_exists"), F.lit(False))
    c_dead = F.coalesce(F.col("c_dead"), F.lit(False))
    t = t.select(
        "*",
        (~loc0 | c_exists).alias("exists"),
        F.when(loc0, F.coalesce("c_cid", "loc_cid_at")).otherwise(F.col("loc_cid_at")).alias("cid_at"),
        F.when(loc0, F.coalesce("c_cid", "loc_cid_before")).otherwise(F.col("loc_cid_before")).alias("cid_before"),
        F.when(loc0, c_dead | F.when(F.col("c_cid").isNull(), F.col("loc_deadnc_before"))
               .otherwise(F.col("loc_r_before"))).otherwise(F.col("loc_deadnc_before")).alias("was_dead"),
        F.when(loc0, F.coalesce(F.col("c_def"), F.lit(False)) | F.col("loc_def_before"))
        .otherwise(F.col("loc_def_before")).alias("def_before"),
        F.when(loc0, F.coalesce("c_drcpt", "loc_drcpt_before")).otherwise(F.col("loc_drcpt_before")).alias("drcpt_before"),
        F.when(loc0, F.col("c_msg_id")).otherwise(F.col("seg_msg_id")).alias("life_msg_id"),
    )
    alive = F.col("exists") & ~F.col("was_dead")
    k = F.col("kind")
    emit = alive & F.col("cid_at").isNotNull() & (
        (k == "A") | ((k == "E") & F.col("def_before") & F.col("drcpt_before").isNotNull()))
    return t.withColumn("alive", alive).withColumn("emit", emit)


def emitted_records(traced: DataFrame) -> DataFrame:
    """Delivery records (before classification) from a traced frame."""
    is_e = F.col("kind") == "E"
    return traced.where("emit").select(
        F.col("cid_at").alias("client_id"),
        F.col("event_ms").alias("date_ms"),
        "queue_id",
        F.col("life_msg_id").alias("msg_id"),
        F.when(is_e, F.col("drcpt_before")).otherwise(F.col("rcpt_email")).alias("rcpt_email"),
        F.when(is_e, F.col("sender_email")).otherwise(F.lit(P.SENDER_UNKNOWN)).alias("sender_email"),
        "status", "info",
        (is_e | F.col("def_before")).alias("has_been_deferred"),
        F.col("file").alias("source_file"),
    )


def open_queues(parsed: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Queues still open after the last line (LIFE-2): the state to carry on.

    Needs only the split summaries, never the per-line evaluation."""
    summ = _chunk_summaries(_row_windows(parsed))
    if seed is not None:
        summ = summ.unionByName(_seed_summaries(seed))
    return _open_from_folded(_fold_summaries(summ))


def _open_from_folded(folded: DataFrame, timed: bool = False) -> DataFrame:
    order = F.struct("neg_rot", "file", "block_start")
    last = folded.groupBy("queue_id").agg(
        F.max_by(F.struct("e_exists", "e_dead", "e_msg_id", "e_cid", "e_drcpt", "e_def", "e_last_ms"), order).alias("s"))
    return last.where(F.col("s.e_exists") & ~F.col("s.e_dead")).select(
        "queue_id",
        F.col("s.e_msg_id").alias("msg_id"),
        F.col("s.e_cid").alias("client_id"),
        F.col("s.e_drcpt").alias("rcpt_email"),
        F.col("s.e_def").alias("has_been_deferred"),
        *([F.col("s.e_last_ms").alias("last_ms")] if timed else []),
    )


class Correlation(NamedTuple):
    records: DataFrame      # unclassified delivery records
    open_queues: DataFrame  # state to hand to the next run
    traced: DataFrame       # per-line state (diagnostics, counters)
    table: tuple[str, str] | None = None  # name and path of the row table, if there is one


BUCKET_BYTES = 256 << 20


def _bucketed_table(rows: DataFrame, input_bytes: int) -> DataFrame:
    """Write rows as a Parquet table bucketed on the split key, in the shared
    checkpoint folder; its scan reports the hash layout, so neither consumer
    shuffles the rows again, and the lineage is cut.  Buckets follow the size of the input."""
    import uuid

    from ..session import checkpoint_dir

    spark = rows.sparkSession
    n = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // BUCKET_BYTES)))
    name = f"relaylens_rows_{uuid.uuid4().hex[:16]}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    (rows.repartition(n, *_CHUNK).write.format("parquet").bucketBy(n, *_CHUNK).option("path", path)
        .mode("overwrite").saveAsTable(name))
    return spark.table(name), (name, path)


def drop_rows(corr: Correlation) -> None:
    """Drops the row table of a correlation whose results are written."""
    if corr.table:
        from .. import storage

        spark = corr.traced.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {corr.table[0]}")
        storage.delete(spark, corr.table[1])


def _materialize(rows: DataFrame, how: str | None, input_bytes: int):
    if how is None:
        return rows, None
    if how == "table":
        return _bucketed_table(rows, input_bytes)
    if how == "checkpoint":
        return rows.checkpoint(eager=True), None
    raise ValueError("materialize must be None, 'table' or 'checkpoint'")


def correlate(parsed: DataFrame, open_queues_seed: DataFrame | None = None,
              materialize: str | None = None, input_bytes: int = 0, ttl_ms: int | None = None, keep=None) -> Correlation:
    """LIFE-1 and LIFE-3: follow every queue; optionally continue from a seed.

    The windowed rows feed two consumers (the split summaries and the final
    per-line evaluation).  ``materialize='table'`` writes them once as a
    Parquet table bucketed on the split key in the shared checkpoint folder
    (lineage cut, hash layout kept, so neither consumer shuffles them again; ``drop_rows`` removes it);
    ``'checkpoint'`` cuts lineage but loses the layout; ``None`` leaves one lazy plan in which Spark
    recomputes the shared part.

    ``keep`` (``Scratch.keep``, say) stores the folded summaries, at most a row per queue and split, for callers that read more than
    one of the results: every one of them is made from the fold, which is else summed up and sorted again for each.

    ``parsed`` with ``line_ms`` gives open queues with ``last_ms``, the date of their last line; ``ttl_ms`` needs ``log_ms``, too
    (``with_log_time``)."""
    rows, table = _materialize(_row_windows(parsed, ttl_ms), materialize, input_bytes)
    summ = _chunk_summaries(rows)
    if open_queues_seed is not None:
        summ = summ.unionByName(_seed_summaries(open_queues_seed))
    folded = _fold_summaries(summ, ttl_ms)
    if keep is not None:
        folded = keep(folded)
    traced = _traced(rows, folded)
    return Correlation(emitted_records(traced), _open_from_folded(folded, "line_ms" in parsed.columns), traced, table)


def _entry_open_before(timed: bool = False) -> Column:
    """Whether the queue had a live entry just before this line; with ``timed`` one that had not expired."""
    w = Window.partitionBy(*_CHUNK).orderBy("line_seq")
    dead_row = F.col("is_r") | (F.col("is_ae") & F.col("cid_at").isNull())
    carried_alive = F.coalesce(F.col("c_exists"), F.lit(False)) & ~F.coalesce(F.col("c_dead"), F.lit(False))
    open_before = F.coalesce(F.lag(F.col("alive") & ~dead_row).over(w), carried_alive)
    return open_before & ~F.col("late") if timed else open_before


def lifecycle_diagnostics(traced: DataFrame) -> DataFrame:
    """LIFE-4: duplicate message-ids, client-ids without a queue, bad expiries."""
    k = F.col("kind")
    cid_ok = F.col("alive") & F.col("cid_at").isNotNull()
    reason = (
        F.when((k == "M") & _entry_open_before("late" in traced.columns), F.lit("duplicate message-id"))
        .when((k == "C") & ~F.col("alive"), F.lit("client-id without queue"))
        .when((k == "E") & cid_ok & ~F.col("def_before"), F.lit("expired, never deferred"))
        .when((k == "E") & cid_ok & F.col("drcpt_before").isNull(), F.lit("expired without recipient"))
    )
    return traced.select("file", "line_seq", "queue_id", "kind", reason.alias("reason")).where(
        F.col("reason").isNotNull())


def ingest_stats(traced: DataFrame) -> DataFrame:
    """LIFE-5 / AGG-7: per-file counters of one ingest run."""
    k = F.col("kind")
    t = traced.select(
        "file", "event_ms", "kind", "emit",
        ((k == "M") & ~_entry_open_before("late" in traced.columns)).alias("new_mid"),
        ((k == "C") & F.col("alive") & F.col("cid_before").isNull()).alias("cid_set"),
    )
    return t.groupBy("file").agg(
        F.count_if("new_mid").alias("message_id_lines"),
        F.count_if("cid_set").alias("client_id_lines"),
        F.count_if("emit").alias("attempts"),
        F.count_if(k == "R").alias("removed_lines"),
        F.max("event_ms").alias("last_line_ms"),
    )
