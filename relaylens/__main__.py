"""Command line: run the indexing job, query the index, print status aggregates.

  python -m relaylens index  --log-dir /var/log --index-dir /data/mailidx [--rules rules.xml]
  python -m relaylens query  --index-dir /data/mailidx --client c1 [--rcpt a@b] [--queue Q] [--msg M]
                             [--from-ms N] [--to-ms N] [--last | --first] [--group-by msgId]
                             [--slice-ms N] [--include-ok] [--out path]
  python -m relaylens status --index-dir /data/mailidx recipient-counts|recipients|unknown-bounces|
                             index-age|client-ids|client-record-counts|
                             diagnostics|ingest-stats|rule-hits|ingested-files|skipped-files|
                             rejected-lines|open-queues|recipient-estimates [--out path]
  python -m relaylens stream --landing-dir /data/chunks --index-dir /data/mailidx [--once] [--ttl-ms N]
  python -m relaylens compact --index-dir /data/mailidx
  python -m relaylens reclassify --index-dir /data/mailidx --rules rules.xml --out /data/reclassified

Results are JSON objects, one per row: written by Spark to ``--out`` or
streamed to stdout partition by partition (``toLocalIterator``); use ``--out`` for large results.
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators import query as QY
from .operators import status as ST
from .plans import index_job as IJ
from .plans import sink as SK
from .plans.sink import to_json_rows
from .schema import INGESTED_FILES, OPEN_QUEUES, SKIPPED_FILES

STATUS = {
    "recipient-counts": ST.recipient_counts,
    "recipients": ST.recipients,
    "unknown-bounces": ST.unknown_bounces,
    "index-age": ST.index_age,
    "client-ids": ST.client_ids,
    "client-record-counts": ST.client_record_counts,
}


# tables the index job appends per run
RUN_TABLES = {"diagnostics": IJ.DIAGNOSTICS, "ingest-stats": IJ.STATS, "rule-hits": IJ.RULE_HITS, "ingested-files": INGESTED_FILES,
              "skipped-files": SKIPPED_FILES, "rejected-lines": IJ.REJECTED}


def _emit(df, out: str | None) -> None:
    rows = to_json_rows(df)
    if out:
        rows.write.mode("overwrite").text(out)
        return
    for r in rows.toLocalIterator():
        sys.stdout.write(r.json + "\n")


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="relaylens")
    sub = ap.add_subparsers(dest="cmd", required=True)

    ix = sub.add_parser("index", help="index new log files")
    ix.add_argument("--log-dir", required=True)
    ix.add_argument("--index-dir", required=True)
    ix.add_argument("--rules")
    ix.add_argument("--budget-mb", type=float, help="read at most so much, newest files first; the others are listed in skipped-files")
    ix.add_argument("--time-zone", default="UTC")
    ix.add_argument("--include-live", action="store_true")
    ix.add_argument("--adaptive-rule-order", action="store_true")
    ix.add_argument("--ttl-ms", type=int, help="queues expire when the log time is so far past their last line")

    sm = sub.add_parser("stream", help="index landed chunks of the live log, from the last run on")
    sm.add_argument("--landing-dir", required=True)
    sm.add_argument("--index-dir", required=True)
    sm.add_argument("--rules")
    sm.add_argument("--time-zone", default="UTC")
    sm.add_argument("--max-files", type=int)
    sm.add_argument("--ttl-ms", type=int)
    sm.add_argument("--once", action="store_true", help="stop when no chunk is left")

    cp = sub.add_parser("compact", help="merge the folders of many runs into few")
    cp.add_argument("--index-dir", required=True)

    rc = sub.add_parser("reclassify", help="the records under a changed rule list, as a new table")
    rc.add_argument("--index-dir", required=True)
    rc.add_argument("--rules", required=True)
    rc.add_argument("--out", required=True)

    q = sub.add_parser("query", help="one client's delivery records")
    q.add_argument("--index-dir", required=True)
    q.add_argument("--client", required=True)
    q.add_argument("--rcpt")
    q.add_argument("--queue")
    q.add_argument("--msg")
    q.add_argument("--from-ms", type=int)
    q.add_argument("--to-ms", type=int)
    g = q.add_mutually_exclusive_group()
    g.add_argument("--last", action="store_true")
    g.add_argument("--first", action="store_true")
    q.add_argument("--group-by", help="rcptEmail, queueId, msgId or A-and-B")
    q.add_argument("--slice-ms", type=int, help="time-sliced batch of the query (needs --from-ms)")
    q.add_argument("--include-ok", action="store_true")
    q.add_argument("--descending", action="store_true")
    q.add_argument("--out")

    st = sub.add_parser("status", help="aggregates over all clients")
    st.add_argument("--index-dir", required=True)
    st.add_argument("what", choices=[*sorted(STATUS), *sorted(RUN_TABLES), "open-queues", "recipient-estimates"])
    st.add_argument("--out")

    a = ap.parse_args(argv)
    from .session import get_spark

    spark = get_spark("relaylens-cli")
    if a.cmd == "index":
        from .plans.index_job import run_index

        res = run_index(spark, a.log_dir, a.index_dir, a.rules, a.budget_mb, time_zone=a.time_zone,
                        include_live=a.include_live, adaptive_rule_order=a.adaptive_rule_order, ttl_ms=a.ttl_ms)
        sys.stdout.write(json.dumps({"indexed_files": res.files}) + "\n")
        return 0
    if a.cmd == "status" and a.what in RUN_TABLES:
        _emit(SK.read_table(spark, a.index_dir, a.what.replace("-", "_"), RUN_TABLES[a.what]), a.out)
        return 0
    if a.cmd == "compact":
        from .plans.compact import compact_index

        sys.stdout.write(json.dumps({"merged_runs": compact_index(spark, a.index_dir)}) + "\n")
        return 0
    if a.cmd == "status" and a.what == "recipient-estimates":
        _emit(IJ.recipient_estimates(spark, a.index_dir), a.out)
        return 0
    if a.cmd == "status" and a.what == "open-queues":
        found = SK.read_open_queues(spark, f"{a.index_dir}/open_queues")
        _emit(found if found is not None else spark.createDataFrame([], OPEN_QUEUES), a.out)
        return 0
    if a.cmd == "stream":
        from .streaming.stream import start_index_stream, stream_mail_logs

        rules, note = IJ.current_rules(spark, a.index_dir, a.rules)
        if note:
            sys.stderr.write(note + "\n")
        q = start_index_stream(stream_mail_logs(spark, a.landing_dir, a.max_files), rules, a.index_dir, f"{a.index_dir}/stream-checkpoint",
                               a.time_zone, a.ttl_ms, {"availableNow": True} if a.once else None)
        q.awaitTermination()
        return 0
    idx = SK.read_index(spark, a.index_dir)
    if a.cmd == "reclassify":
        from .operators.classify import reclassify

        rules, note = IJ.current_rules(spark, a.index_dir, a.rules)
        if note:
            sys.stderr.write(note + "\n")
        SK.write_deliveries(reclassify(idx, rules), a.out)
        return 0
    if a.cmd == "status":
        _emit(STATUS[a.what](idx), a.out)
        return 0
    last = True if a.last else (False if a.first else None)
    if a.slice_ms:
        if a.from_ms is None:
            ap.error("--slice-ms needs --from-ms")
        df = QY.query_slices(idx, a.client, a.from_ms, a.to_ms, a.slice_ms, rcpt_email=a.rcpt,
                             queue_id=a.queue, msg_id=a.msg, last=last, group_by=a.group_by,
                             include_ok=a.include_ok)
    else:
        df = QY.query_deliveries(idx, a.client, a.rcpt, a.queue, a.msg, a.from_ms, a.to_ms, last,
                                 a.group_by, a.include_ok, a.descending)
    _emit(df, a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
