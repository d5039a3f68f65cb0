import random

import pytest

from relaylens.operators import lifecycle as LC
from relaylens.operators.lifecycle import correlate, ingest_stats, lifecycle_diagnostics, open_queues
from relaylens.operators.parse import parse_lines
from relaylens.plans.pipeline import build_deliveries
from relaylens.sources.rules import default_rules
from tests import automaton, fixture_log
from tests import fixture_log as F

PARSED_SCHEMA = ("file string, rotation int, block_start long, line_seq long, kind string, queue_id string, "
                 "event_ms long, rcpt_email string, sender_email string, status string, info string, "
                 "msg_id string, client_id string")


def _records(df):
    cols = ["client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info",
            "has_been_deferred"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("split_every", [None, 3, 7])
def test_single_client_fixture(spark, split_every):
    raw = fixture_log.raw_lines_df(spark, split_every=split_every)
    idx = build_deliveries(raw, default_rules(spark))
    rows = idx.deliveries.collect()
    assert len(rows) == 11
    assert {r.client_id for r in rows} == {fixture_log.CLIENT}
    assert all(v is not None for r in rows for v in r)  # no null field in any record
    by_q = {}
    for r in rows:
        by_q.setdefault(r.queue_id, []).append(r)
    assert sorted((q, len(v)) for q, v in by_q.items()) == sorted(
        [(F.Q_OK, 1), (F.Q_BOUNCED, 1), (F.Q_EXPIRED, 5), (F.Q_LATE, 4)])
    assert [(r.state, r.state_info) for r in by_q[F.Q_OK]] == [(3, "OK")]
    assert [(r.state, r.state_info) for r in by_q[F.Q_BOUNCED]] == [(1, "spam detection and blacklisting")]
    q3 = sorted(by_q[F.Q_EXPIRED], key=lambda r: r.date_ms)
    assert [(r.status, r.state, r.state_info) for r in q3[:4]] == [
        ("deferred", 0, "bad domain: connection timeout")] * 4
    expired = q3[4]
    assert (expired.status, expired.state, expired.state_info) == ("expired", 0, "expired, returned to sender")
    assert (expired.rcpt_email, expired.sender_email) == ("third@example.net", "bills@example.org")
    q4 = sorted(by_q[F.Q_LATE], key=lambda r: r.date_ms)
    assert [(r.state, r.state_info) for r in q4[-1:]] == [(4, "finally OK")]
    assert {r.msg_id for r in q4} == {"msgId-web-55"}
    assert {r.sender_email for r in rows if r.status != "expired"} == {"unknown"}
    assert {r.msg_id for r in rows} == {"98494.7001.11", "98494.7002.22", "98494.7003.33", "msgId-web-55"}
    opened = idx.open_queues.collect()
    assert [(o.queue_id, o.client_id, o.has_been_deferred, o.rcpt_email) for o in opened] == [
        (F.Q_LATE, F.CLIENT, True, "fourth@example.net")]


def _random_trace(rng, n_queues=12, n_lines=400):
    qids = [f"Q{i:014d}" for i in range(n_queues)]
    rows = []
    for seq in range(n_lines):
        qid = rng.choice(qids)
        kind = rng.choices("MCAER", weights=[2, 2, 6, 1, 1])[0]
        row = dict(kind=kind, queue_id=qid, event_ms=None, rcpt_email=None, sender_email=None, status=None,
                   info=None, msg_id=None, client_id=None)
        if kind == "M":
            row["msg_id"] = f"m{seq}"
            row["client_id"] = rng.choice([None, None, "c1", "c2"])
        elif kind == "C":
            row["client_id"] = rng.choice(["c1", "c2", "c3"])
        elif kind == "A":
            row.update(event_ms=seq * 1000, rcpt_email=f"r{rng.randint(0, 3)}@x", info="try again later",
                       status=rng.choice(["deferred", "deferred", "sent", "bounced"]))
        elif kind == "E":
            row.update(event_ms=seq * 1000, sender_email="s@x", status="expired", info="returned to sender")
        rows.append(row)
    return rows


def _to_df(spark, rows, n_files=3, blocks_per_file=3):
    """Lay the trace out over files (oldest = highest rotation) and splits."""
    per_file = -(-len(rows) // n_files)
    data = []
    for i, r in enumerate(rows):
        f = i // per_file
        within = i - f * per_file
        block = (within * blocks_per_file // per_file) * 1000
        data.append((f"mail.log.{n_files - f}", n_files - f, block, within, r["kind"], r["queue_id"],
                     r["event_ms"], r["rcpt_email"], r["sender_email"], r["status"], r["info"], r["msg_id"],
                     r["client_id"]))
    return spark.createDataFrame(data, PARSED_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_random_traces_match_sequential_automaton(spark, seed):
    rng = random.Random(seed)
    rows = _random_trace(rng)
    expected, still_open = automaton.run(rows)
    corr = correlate(_to_df(spark, rows), materialize=[None, "table", "checkpoint", "table"][seed % 4])
    got = _records(corr.records)
    assert got == sorted(expected)
    opened = {o.queue_id: (o.msg_id, o.client_id, o.rcpt_email, o.has_been_deferred)
              for o in corr.open_queues.collect()}
    assert opened == {k: tuple(v) for k, v in still_open.items()}
    # diagnostics, located by (file, line) of the laid-out trace
    df = _to_df(spark, rows)
    pos = {(r.file, r.line_seq): i for i, r in enumerate(df.select("file", "line_seq").collect())}
    diag = sorted((pos[(r.file, r.line_seq)], r.reason) for r in lifecycle_diagnostics(corr.traced).collect())
    assert diag == sorted(automaton.diagnostics(rows))


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_continuing_from_open_queues_equals_one_run(spark, seed):
    rng = random.Random(seed)
    rows = _random_trace(rng, n_lines=300)
    expected, _ = automaton.run(rows)
    first, second = rows[:140], rows[140:]
    c1 = correlate(_to_df(spark, first, n_files=2))
    seed_df = c1.open_queues
    c2 = correlate(_to_df(spark, second, n_files=2), seed_df)
    got = sorted(_records(c1.records) + _records(c2.records))
    assert got == sorted(expected)


def test_one_hot_queue_spread_over_many_splits(spark):
    rng = random.Random(7)
    rows = _random_trace(rng, n_queues=1, n_lines=600)
    expected, _ = automaton.run(rows)
    got = _records(correlate(_to_df(spark, rows, n_files=4, blocks_per_file=6)).records)
    assert got == sorted(expected)


def test_open_queues_function_and_counters(spark):
    parsed = parse_lines(fixture_log.raw_lines_df(spark))
    assert [r.queue_id for r in open_queues(parsed).collect()] == [F.Q_LATE]
    traced = correlate(parsed).traced
    st = ingest_stats(traced).collect()[0]
    assert (st.message_id_lines, st.client_id_lines, st.attempts, st.removed_lines) == (4, 1, 11, 3)
    assert lifecycle_diagnostics(traced).count() == 0


def test_diagnostics(spark):
    lines = [
        ("M", "Q00000000000001", None, None, None, "m1", "c1"),
        ("M", "Q00000000000001", None, None, None, "m2", "c1"),     # duplicate while open
        ("C", "Q00000000000002", None, None, None, None, "c9"),     # no queue
        ("M", "Q00000000000003", None, None, None, "m3", "c1"),
        ("E", "Q00000000000003", 5, None, "expired", None, None),   # never deferred
    ]
    data = [("f", 1, 0, i, k, q, ms, None, "s@x" if k == "E" else None, st, "x", m, c)
            for i, (k, q, ms, _r, st, m, c) in enumerate(lines)]
    traced = correlate(spark.createDataFrame(data, PARSED_SCHEMA)).traced
    reasons = sorted((r.queue_id, r.reason) for r in lifecycle_diagnostics(traced).collect())
    assert reasons == [("Q00000000000001", "duplicate message-id"), ("Q00000000000002", "client-id without queue"),
                       ("Q00000000000003", "expired, never deferred")]


def test_splits_are_sorted_once_and_summarised_by_their_last_line(spark):
    parsed = parse_lines(spark.createDataFrame([], "file string, rotation int, block_start long, line_seq long, line string"))
    rows = LC._row_windows(parsed)
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") > 1
    executed = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert executed.count("Sort [") == 1
    assert "Aggregate" not in LC._chunk_summaries(rows)._jdf.queryExecution().optimizedPlan().toString()
