"""

``entry(spark)`` runs the flagship query on /root/testdata/sf0.001;
``oracle_sql()`` gives the DuckDB twin of each (same column names).

Every query reads the driver's tables: the mail log is rendered from the
whole ``events`` table (``stand_in_log``) and then goes through the
library's real parser, lifecycle scan, classifier and query operators.
"""

from __future__ import annotations

import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from xml.sax.saxutils import escape, quoteattr

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from relaylens.operators import classify as CL  # noqa: E402
from relaylens.operators import lifecycle as LC  # noqa: E402
from relaylens.operators import query as QY  # noqa: E402
from relaylens.operators import status as ST  # noqa: E402
from relaylens.operators.parse import parse_lines, rejected_lines  # noqa: E402
from relaylens import storage  # noqa: E402
from relaylens.plans.compact import merge_runs, vacuum  # noqa: E402
from relaylens.plans.index_job import read_rule_hits, recipient_estimates, run_index  # noqa: E402
from relaylens.plans.pipeline import build_deliveries, distinct_records, to_delivery_rows  # noqa: E402
from relaylens.plans.sink import committed_runs, read_deliveries, read_index, to_json_rows, write_deliveries  # noqa: E402
from relaylens.session import checkpoint_dir, ship_package  # noqa: E402
from relaylens.sources import logfiles as LF  # noqa: E402
from relaylens.sources.default_rules import DEFAULT_RULES  # noqa: E402
from relaylens.sources.rules import default_rules, load_bounce_rules, validate_bounce_rules, write_rules_xml  # noqa: E402
from relaylens.streaming.runner import land_chunks, run_landed_stream  # noqa: E402
from stand_in_log import synthetic_raw_lines  # noqa: E402


# the training-data operators and their pipeline may be absent; if they are there, their import errors show
if importlib.util.find_spec("relaylens.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
    from relaylens.llm import queries as LLM

    LLM_QUERIES, LLM_ORACLES = LLM.QUERIES | {"pipeline": corpus_pipeline.run}, LLM.oracle_sql
else:
    LLM_QUERIES, LLM_ORACLES = {}, dict


def _ms(s: str) -> int:
    return int(datetime.strptime(s, "%Y-%m-%d %H:%M").replace(tzinfo=timezone.utc).timestamp() * 1000)


# Query parameters (what a client would pass)
CLIENT = "client-1"
RCPT = ("client-2", "user2-1@example.com")
QUEUE = ("client-2", "Q000007W0002818")
MSG = ("client-1", "msgId-1037")
RANGE = (_ms("2024-01-08 00:00"), _ms("2024-01-15 00:00"))
SLICES = (_ms("2024-01-03 10:00"), _ms("2024-01-10 10:00"), 86_400_000)
BUDGET_MB = 1.0
LEDGER_MIN_ROTATION = 350
TTL_MS = 43_200_000  # half a day

RECORD = QY.RECORD_FIELDS


def _raw(spark, sf_dir):
    ship_package(spark)  # Python tasks (streaming state) import the package
    return synthetic_raw_lines(spark, sf_dir)


def _index(spark, sf_dir):
    # the index job's plan: windowed lines checkpointed once, read by both
    # the split summaries and the per-line evaluation
    checkpoint_dir(spark)
    return build_deliveries(_raw(spark, sf_dir), default_rules(spark), materialize="table")


def _deliveries(spark, sf_dir) -> DataFrame:
    return _index(spark, sf_dir).deliveries


def _traced(spark, sf_dir) -> DataFrame:
    checkpoint_dir(spark)
    return LC.correlate(parse_lines(_raw(spark, sf_dir)), materialize="table").traced


def _files(spark, sf_dir) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return raw.groupBy("file").agg(
        F.first("rotation").alias("rotation"),
        F.sum(F.octet_length("line") + 1).cast("long").alias("size_bytes"),
    )


def _digests(spark, sf_dir) -> DataFrame:
    return LF.digests_from_lines(_raw(spark, sf_dir))


def _ledger(spark, sf_dir) -> DataFrame:
    d = _digests(spark, sf_dir).join(_files(spark, sf_dir), "file")
    return d.where(F.col("rotation") >= LEDGER_MIN_ROTATION).select("file", "digest")


def _q_parse_lines(spark, sf_dir):
    return parse_lines(_raw(spark, sf_dir)).select(
        "file", "line_seq", "kind", "queue_id", "event_ms", "rcpt_email", "sender_email", "status", "info",
        "msg_id_raw", "msg_id", "client_id")


def _q_rejected(spark, sf_dir):
    return rejected_lines(_raw(spark, sf_dir))


def _q_correlate(spark, sf_dir):
    return LC.correlate(parse_lines(_raw(spark, sf_dir))).records.drop("source_file")


def _q_open_queues(spark, sf_dir):
    return LC.open_queues(parse_lines(_raw(spark, sf_dir)))


def _q_diagnostics(spark, sf_dir):
    return LC.lifecycle_diagnostics(_traced(spark, sf_dir))


def _q_ingest_stats(spark, sf_dir):
    return LC.ingest_stats(_traced(spark, sf_dir))


def _q_deliveries(spark, sf_dir):
    return _deliveries(spark, sf_dir).select(*RECORD)


def _classified(spark, sf_dir):
    """The job's form: one classification of all records, rule ids kept, before the set."""
    checkpoint_dir(spark)
    records = LC.correlate(parse_lines(_raw(spark, sf_dir)), materialize="table").records
    return CL.classify(records, default_rules(spark), keep_rule_id=True)


def _q_rule_hits(spark, sf_dir):
    return CL.bounce_rule_hits(_classified(spark, sf_dir), default_rules(spark))


def _q_reclassify(spark, sf_dir):
    rules = default_rules(spark)
    classified = _classified(spark, sf_dir).checkpoint()
    hits = CL.bounce_rule_hits(classified, rules).select("rule_id", "hits")
    index = distinct_records(to_delivery_rows(classified))
    return CL.reclassify(index.select(*RECORD), rules, hits=hits)


def _q_listing(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT)


def _q_rcpt(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), RCPT[0], rcpt_email=RCPT[1])


def _q_queue(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), QUEUE[0], queue_id=QUEUE[1])


def _q_msg(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), MSG[0], msg_id=MSG[1])


def _q_range(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, from_ms=RANGE[0], to_ms=RANGE[1])


def _q_last(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, last=True)


def _q_first(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, from_ms=RANGE[0], last=False)


def _q_group_rcpt(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, group_by="rcptEmail")


def _q_group_tuple(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, group_by="rcptEmail-and-queueId")


def _q_group_last(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, group_by="msgId", last=True)


def _q_tuple_first(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, to_ms=RANGE[1],
                               group_by="queueId-and-rcptEmail", last=False)


def _q_slices(spark, sf_dir):
    return QY.query_slices(_deliveries(spark, sf_dir), CLIENT, SLICES[0], SLICES[1], SLICES[2],
                           group_by="msgId")


def _q_recipient_counts(spark, sf_dir):
    return ST.recipient_counts(_deliveries(spark, sf_dir))


def _q_recipients(spark, sf_dir):
    return ST.recipients(_deliveries(spark, sf_dir))


def _q_unknown(spark, sf_dir):
    return ST.unknown_bounces(_deliveries(spark, sf_dir))


def _q_index_age(spark, sf_dir):
    return ST.index_age(_deliveries(spark, sf_dir))


def _q_client_ids(spark, sf_dir):
    return ST.client_ids(_deliveries(spark, sf_dir))


def _q_records_by_client(spark, sf_dir):
    return ST.records_by_client(_deliveries(spark, sf_dir), RANGE[0], RANGE[1])


def _q_client_counts(spark, sf_dir):
    return ST.client_record_counts(_deliveries(spark, sf_dir))


def _q_budget(spark, sf_dir):
    return LF.select_log_files(_files(spark, sf_dir), BUDGET_MB, live_size_bytes=0)


def _q_digests(spark, sf_dir):
    return _digests(spark, sf_dir)


def _q_skip(spark, sf_dir):
    return LF.skip_ingested(_digests(spark, sf_dir), _ledger(spark, sf_dir))


def _q_ingested(spark, sf_dir):
    return LF.ingested_log_files(_digests(spark, sf_dir), _ledger(spark, sf_dir))


def _q_json(spark, sf_dir):
    d = QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, include_ok=True, sort=False)
    return to_json_rows(d)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _q_newest_first(spark, sf_dir):
    return QY.query_deliveries(_deliveries(spark, sf_dir), CLIENT, descending=True)


def _q_slices_half_open(spark, sf_dir):
    return QY.query_slices(_deliveries(spark, sf_dir), CLIENT, SLICES[0], SLICES[1], SLICES[2],
                           boundary="half_open", group_by="msgId")


def _q_written_index(spark, sf_dir):
    """Write the index, read it back, write the same records again: nothing changes."""
    path = _scratch(spark, "written")
    write_deliveries(_deliveries(spark, sf_dir), path)
    write_deliveries(read_deliveries(spark, path), path)
    return read_deliveries(spark, path).select(*RECORD)


def _land_files(spark, sf_dir, path):
    """The stand-in log as rotated text files, one per day; every third is compressed, the newest is not."""
    raw = _raw(spark, sf_dir)
    days = [r.rotation for r in raw.select("rotation").distinct().collect()]
    newest = min(days, default=0)
    raw = raw.withColumn("gz", (F.col("rotation") % 3 == 0) & (F.col("rotation") != newest))
    jvm = spark.sparkContext._jvm
    for gz in (False, True):
        # a task per file: hashes of days would put several files into one task and none into others
        mine = [day for day in days if (day % 3 == 0 and day != newest) == gz]
        if not mine:
            continue
        part = raw.where(F.col("gz") == gz).select("rotation", "block_start", "line_seq", "line")
        place = F.array_position(F.lit(mine), F.col("rotation")).cast("int") - 1
        (part.repartitionById(len(mine), place).sortWithinPartitions("rotation", "block_start", "line_seq")
            .select("line", "rotation").write.partitionBy("rotation").option("compression", "gzip" if gz else "none").text(f"{path}/parts{gz}"))
    for day in days:
        gz = day % 3 == 0 and day != newest
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/parts{gz}/rotation={day}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/logs"))
        parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        fs.rename(parts[0], jvm.org.apache.hadoop.fs.Path(f"{path}/logs/mail.log.{day}{'.gz' if gz else ''}"))
    return f"{path}/logs"


def _q_read_logs(spark, sf_dir):
    logs = _land_files(spark, sf_dir, _scratch(spark, "files"))
    files = LF.list_log_files(spark, logs)
    raw = LF.read_mail_logs(spark, [r.path for r in files.select("path").collect()])
    return LF.numbered_lines(raw).select(F.regexp_replace("file", r"\.gz$", "").alias("file"), "rotation", "line_no", "line")


def _q_indexed_files(spark, sf_dir):
    """The index job over the files in two runs, the older half first: continuation, ledger, commit, read-back."""
    path = _scratch(spark, "job")
    logs = _land_files(spark, sf_dir, path)
    days = sorted(r.rotation for r in LF.list_log_files(spark, logs).select("rotation").collect())
    later = "|".join(str(d) for d in days[len(days) // 2:])
    run_index(spark, logs, f"{path}/index", pattern=rf"mail\.log\.({later})(?:\.gz)?")
    run_index(spark, logs, f"{path}/index")
    return read_index(spark, f"{path}/index").select(*RECORD)


def _copy_start(spark, source, target, share):
    """A live file as a reader finds it while it is written: the first part of ``source``, cut inside a line."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = src.getFileSystem(conf)
    n = int(fs.getFileStatus(src).getLen() * share)
    while storage.read_bytes(spark, source, n - 1, 1) in (b"\n", b"\r"):
        n -= 1
    a, b = fs.open(src), fs.create(dst, True)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(a, b, n, True)


def _live_growth(spark, sf_dir):
    """An index whose newest file was live: read twice in the middle of a line, then whole after its rotation."""
    path = _scratch(spark, "live")
    logs = _land_files(spark, sf_dir, path)
    newest = min(storage.names(spark, logs), key=lambda n: int(n.split(".")[2]))
    aside = f"{path}/{newest}"
    storage.move(spark, f"{logs}/{newest}", aside, 1_700_000_000_000)
    for share in (0.4, 0.75):
        _copy_start(spark, aside, f"{logs}/mail.log", share)
        run_index(spark, logs, f"{path}/index", include_live=True)
    storage.delete(spark, f"{logs}/mail.log")
    storage.move(spark, aside, f"{logs}/{newest}", 1_700_000_100_000)
    run_index(spark, logs, f"{path}/index", include_live=True)
    return f"{path}/index"


def _q_live_growth(spark, sf_dir):
    return read_index(spark, _live_growth(spark, sf_dir)).select(*RECORD)


def _q_live_hits(spark, sf_dir):
    return read_rule_hits(spark, _live_growth(spark, sf_dir))


def _three_runs(spark, sf_dir, name):
    """An index of three runs, the files dealt to them by age."""
    path = _scratch(spark, name)
    logs = _land_files(spark, sf_dir, path)
    days = sorted((r.rotation for r in LF.list_log_files(spark, logs).select("rotation").collect()), reverse=True)
    for upto in (len(days) // 3, 2 * len(days) // 3, len(days)):
        chosen = "|".join(map(str, days[:upto]))
        run_index(spark, logs, f"{path}/index", pattern=rf"mail\.log\.({chosen})(?:\.gz)?")
    return f"{path}/index"


def _q_compacted(spark, sf_dir):
    """Three runs merged into one, what they left deleted."""
    index = _three_runs(spark, sf_dir, "compacted")
    merge_runs(spark, index, committed_runs(spark, index))
    vacuum(spark, index)
    return read_index(spark, index).select(*RECORD)


def _q_estimates(spark, sf_dir):
    """Distinct recipients from the sketches of three runs, of which two are merged."""
    index = _three_runs(spark, sf_dir, "sketches")
    merge_runs(spark, index, committed_runs(spark, index)[:2])
    return recipient_estimates(spark, index)


def _q_expired_batch(spark, sf_dir):
    path = _scratch(spark, "ttl")
    run_index(spark, _land_files(spark, sf_dir, path), f"{path}/index", ttl_ms=TTL_MS)
    return read_index(spark, f"{path}/index").select(*RECORD)


def _q_expired_stream(spark, sf_dir):
    """The same through the stream, in four micro-batches."""
    ship_package(spark)
    base = _scratch(spark, "ttl-stream")
    land_chunks(_raw(spark, sf_dir), f"{base}/landing", 4)
    return run_landed_stream(spark, base, default_rules(spark), max_files_per_trigger=1, ttl_ms=TTL_MS).select(*RECORD)


def _q_backfill(spark, sf_dir):
    """The older half of the files by the index job, the newer half through the stream into the same index."""
    ship_package(spark)
    base = _scratch(spark, "backfill")
    logs = _land_files(spark, sf_dir, base)
    days = sorted(r.rotation for r in LF.list_log_files(spark, logs).select("rotation").collect())
    later = days[len(days) // 2:]
    run_index(spark, logs, f"{base}/index", pattern=rf"mail\.log\.({'|'.join(map(str, later))})(?:\.gz)?")
    land_chunks(_raw(spark, sf_dir).where(F.col("rotation") < later[0]), f"{base}/landing", 2)
    return run_landed_stream(spark, base, default_rules(spark), max_files_per_trigger=1).select(*RECORD)


def _q_rules_xml(spark, sf_dir):
    """The rule list written as XML, read and validated, and the records classified by it."""
    path = _scratch(spark, "rules")
    write_rules_xml(f"{path}/rules.xml", [(t, c, p) for t, c, p in DEFAULT_RULES], spark)
    checkpoint_dir(spark)
    rules = load_bounce_rules(spark, f"{path}/rules.xml")
    records = LC.correlate(parse_lines(_raw(spark, sf_dir)), materialize="table").records
    return CL.bounce_rule_hits(CL.classify(records, rules, keep_rule_id=True), rules)


def _q_rule_violations(spark, sf_dir):
    """A rule per supplier, some without category, alternative or text, written as XML and validated."""
    path = _scratch(spark, "violations")
    out = ["<bounces>"]
    key = F.col("s_suppkey")
    rules = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_name", (key % 7 == 0).alias("unnamed"), (key % 11 == 0).alias("bare"), (key % 13 == 0).alias("empty"), key)
    for r in rules.orderBy(key).collect():  # a rule list
        name = "" if r.unnamed else f" category={quoteattr(r.s_name)}"
        alternatives = "" if r.bare else f"<or>{escape(r.s_name)}</or>" + ("<or></or>" if r.empty else "")
        out.append(f'<regex type="soft"{name}>{alternatives}</regex>')
    storage.write_text(spark, f"{path}/rules.xml", "\n".join([*out, "</bounces>"]))
    return validate_bounce_rules(spark, f"{path}/rules.xml")


def _q_stream(spark, sf_dir):
    """Landed chunks through the stream in at least three micro-batches, restarted once."""
    ship_package(spark)
    base = _scratch(spark, "stream")
    raw, rules = _raw(spark, sf_dir), default_rules(spark)
    cut = raw.agg(F.expr("percentile_approx(rotation, 0.5)")).head()[0]
    land_chunks(raw.where(F.col("rotation") >= cut), f"{base}/landing", 2)
    run_landed_stream(spark, base, rules, max_files_per_trigger=1)
    land_chunks(raw.where(F.col("rotation") < cut), f"{base}/landing", 2)
    return run_landed_stream(spark, base, rules, max_files_per_trigger=2).select(*RECORD)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: parse -> lifecycle -> classify -> distinct recipients per client."""
    return _q_recipient_counts(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "parse_lines": _q_parse_lines,
        "rejected_lines": _q_rejected,
        "correlate_records": _q_correlate,
        "open_queues": _q_open_queues,
        "lifecycle_diagnostics": _q_diagnostics,
        "ingest_stats": _q_ingest_stats,
        "deliveries": _q_deliveries,
        "bounce_rule_hits": _q_rule_hits,
        "reclassify_by_hits": _q_reclassify,
        "client_listing": _q_listing,
        "rcpt_filter": _q_rcpt,
        "queue_filter": _q_queue,
        "msg_filter": _q_msg,
        "time_range": _q_range,
        "last_record": _q_last,
        "first_record": _q_first,
        "group_by_rcpt": _q_group_rcpt,
        "group_by_tuple": _q_group_tuple,
        "group_last": _q_group_last,
        "tuple_first": _q_tuple_first,
        "time_slices": _q_slices,
        "recipient_counts": _q_recipient_counts,
        "recipients": _q_recipients,
        "unknown_bounces": _q_unknown,
        "index_age": _q_index_age,
        "client_ids": _q_client_ids,
        "records_by_client": _q_records_by_client,
        "client_record_counts": _q_client_counts,
        "log_file_budget": _q_budget,
        "file_digests": _q_digests,
        "skip_ingested": _q_skip,
        "ingested_log_files": _q_ingested,
        "json_rows": _q_json,
        "newest_first": _q_newest_first,
        "time_slices_half_open": _q_slices_half_open,
        "written_index": _q_written_index,
        "read_log_files": _q_read_logs,
        "indexed_files": _q_indexed_files,
        "stream_deliveries": _q_stream,
        "live_growth": _q_live_growth,
        "live_growth_rule_hits": _q_live_hits,
        "compacted_index": _q_compacted,
        "recipient_estimates": _q_estimates,
        "expired_queues_batch": _q_expired_batch,
        "expired_queues_stream": _q_expired_stream,
        "backfill_then_live": _q_backfill,
        "changed_rules_xml": _q_rules_xml,
        "rule_violations": _q_rule_violations,
    } | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    from oracle_entries import oracle_queries

    return oracle_queries() | LLM_ORACLES()
