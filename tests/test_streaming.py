import os

import pytest

from relaylens.plans.index_job import run_index
from relaylens.plans.pipeline import build_deliveries
from relaylens.plans.sink import committed_runs, read_open_queues
from relaylens.sources.rules import default_rules
from relaylens.streaming.runner import run_landed_stream
from tests import fixture_log

COLS = ["client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info",
        "state", "state_info"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def _batch(spark):
    return _rows(build_deliveries(fixture_log.raw_lines_df(spark), default_rules(spark)).deliveries)


def _land(landing, *chunks):
    os.makedirs(landing, exist_ok=True)
    have = len(os.listdir(landing))
    for i, lines in enumerate(chunks, start=have):
        path = os.path.join(landing, f"chunk-{i:06d}.log")
        with open(path, "w") as fh:
            fh.write("\n".join(lines) + "\n")
        os.utime(path, (1_000_000 + i * 10, 1_000_000 + i * 10))


def test_stream_equals_batch_over_micro_batches_and_a_restart(spark, scratch):
    lines, rules, landing = fixture_log.lines(), default_rules(spark), os.path.join(scratch, "landing")
    _land(landing, lines[:5], lines[5:12], lines[12:15])
    run_landed_stream(spark, scratch, rules, max_files_per_trigger=1)
    _land(landing, lines[15:19], lines[19:])
    out = run_landed_stream(spark, scratch, rules, max_files_per_trigger=1)
    assert _rows(out) == _batch(spark)
    assert len(committed_runs(spark, f"{scratch}/index")) == 5
    last = read_open_queues(spark, f"{scratch}/index/open_queues", committed_runs(spark, f"{scratch}/index"))
    assert [r.queue_id for r in last.collect()] == [fixture_log.Q_LATE]


def test_backfill_then_live(spark, scratch):
    lines, rules = fixture_log.lines(), default_rules(spark)
    logs = os.path.join(scratch, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "mail.log.1"), "w") as fh:
        fh.write("\n".join(lines[:12]) + "\n")
    run_index(spark, logs, f"{scratch}/index")
    _land(os.path.join(scratch, "landing"), lines[12:])
    assert _rows(run_landed_stream(spark, scratch, rules)) == _batch(spark)


def test_replayed_micro_batch_changes_nothing(spark, scratch, monkeypatch):
    from relaylens.plans import index_job

    lines, rules, landing = fixture_log.lines(), default_rules(spark), os.path.join(scratch, "landing")
    _land(landing, lines[:12], lines[12:])
    write = index_job.write_table
    with monkeypatch.context() as m:  # the second micro-batch is lost just before it is committed
        def lost(df, d, name, run):
            if name == "ingested_files" and len(committed_runs(spark, f"{scratch}/index")) == 1:
                raise RuntimeError("lost")
            write(df, d, name, run)

        m.setattr(index_job, "write_table", lost)
        with pytest.raises(Exception, match="lost"):
            run_landed_stream(spark, scratch, rules, max_files_per_trigger=1)
    assert _rows(run_landed_stream(spark, scratch, rules, max_files_per_trigger=1)) == _batch(spark)


def test_queues_expire_with_a_time_to_live(spark, scratch):
    lines, rules, landing = fixture_log.lines(), default_rules(spark), os.path.join(scratch, "landing")
    end = next(i for i, x in enumerate(lines) if "msgId-web-55" in x) + 2
    _land(landing, lines[:end])
    run_landed_stream(spark, scratch, rules)
    _land(landing, [f"2019 Mar 20 00:00:00.000 h postfix/cleanup[1]: {'Z' * 15}: message-id=m"])
    run_landed_stream(spark, scratch, rules, ttl_ms=1)
    _land(landing, lines[end:])
    out = run_landed_stream(spark, scratch, rules)
    assert out.where(f"queue_id = '{fixture_log.Q_LATE}'").count() == 0


def test_late_chunks_are_taken_in_and_reported(spark, scratch):
    from relaylens.plans.index_job import DIAGNOSTICS
    from relaylens.plans.sink import read_table

    rules, landing = default_rules(spark), os.path.join(scratch, "landing")
    _land(landing, ["x"], fixture_log.lines())
    os.rename(os.path.join(landing, "chunk-000000.log"), os.path.join(scratch, "later"))
    run_landed_stream(spark, scratch, rules)
    os.rename(os.path.join(scratch, "later"), os.path.join(landing, "chunk-000000.log"))
    run_landed_stream(spark, scratch, rules)
    assert [r.reason for r in read_table(spark, f"{scratch}/index", "diagnostics", DIAGNOSTICS).collect()] == [
        "chunk chunk-000000.log came after chunk-000001.log"]


def _random_text_trace(seed, n_queues=10, n_lines=300):
    import random

    rng = random.Random(seed)
    qids = [f"R{seed:02d}Q{i:011d}" for i in range(n_queues)]
    out = []
    for i in range(n_lines):
        q = rng.choice(qids)
        k = rng.choices("MCAER", weights=[2, 2, 6, 1, 1])[0]
        stamp = f"2013 Jun {1 + i // 100} 10:{(i // 60) % 60:02d}:{i % 60:02d}.{i % 1000:03d}"
        if k == "M":
            mid = rng.choice([f"<98494.{i}.7@cl{rng.randint(1, 2)}>", f"msgId-{i}"])
            out.append(f"{stamp} h postfix/cleanup[1]: {q}: message-id={mid}")
        elif k == "C":
            out.append(f"{stamp} h postfix/cleanup[1]: {q}: info: header client-id: cl{rng.randint(1, 3)} from x")
        elif k == "A":
            st = rng.choice(["deferred", "deferred", "sent", "bounced"])
            out.append(f"{stamp} h postfix/smtp[1]: {q}: to=<r{rng.randint(0, 3)}@x.cz>, relay=none, "
                       f"status={st} (try again later)")
        elif k == "E":
            out.append(f"{stamp} h postfix/qmgr[1]: {q}: from=<s@x.cz>, status=expired, returned to sender")
        else:
            out.append(f"{stamp} h postfix/qmgr[1]: {q}: removed")
    return out


def test_stream_on_random_traces(spark, scratch):
    from relaylens.operators.parse import parse_lines
    from tests import automaton

    rules = default_rules(spark)
    for seed in (1, 2):
        lines = _random_text_trace(seed)
        base = os.path.join(scratch, f"run{seed}")
        _land(os.path.join(base, "landing"), *[lines[c * 100:(c + 1) * 100] for c in range(3)])
        # seed 2: one chunk per micro-batch, so queue state crosses batches
        out = run_landed_stream(spark, base, rules, max_files_per_trigger=1 if seed == 2 else None)
        got = {tuple(r) for r in out.select("client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info").collect()}
        raw = spark.createDataFrame([("f", 1, 0, i, l) for i, l in enumerate(lines)],
                                    "file string, rotation int, block_start long, line_seq long, line string")
        parsed = [r.asDict() for r in parse_lines(raw).orderBy("line_seq").collect()]
        expected, _ = automaton.run(parsed)
        assert got == {e[:8] for e in expected}


def test_counters_come_with_the_batches(spark, scratch):
    from pyspark.sql import functions as F
    from relaylens.plans.index_job import COUNTERS, STATS
    from relaylens.plans.sink import read_table
    from relaylens.streaming.stream import start_index_stream, stream_mail_logs

    lines, seen, index = fixture_log.lines(), {}, f"{scratch}/index"
    _land(os.path.join(scratch, "landing"), lines[:12], ["no mail line"], lines[12:])
    q = start_index_stream(stream_mail_logs(spark, os.path.join(scratch, "landing"), 1), default_rules(spark), index, f"{scratch}/checkpoint",
                           trigger={"availableNow": True}, on_batch=lambda run, counters: seen.update({run: counters}))
    q.awaitTermination()
    stats = read_table(spark, index, "ingest_stats", STATS).groupBy("run").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_line_ms").alias("last_line_ms"))
    assert seen == {r.run: {c: r[c] for c in (*COUNTERS, "last_line_ms")} for r in stats.collect()}
    assert len(seen) == 3 and sum(c["attempts"] for c in seen.values()) == 11
