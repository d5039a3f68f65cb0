from datetime import datetime, timezone

import pytest

from relaylens.operators import query as QY
from relaylens.operators import status as ST
from relaylens.plans.pipeline import build_deliveries
from relaylens.sources.rules import default_rules
from tests import fixture_log

C = fixture_log.CLIENT


def ms(s):
    return int(datetime.strptime(s, "%Y %b %d %H:%M:%S.%f").replace(tzinfo=timezone.utc).timestamp() * 1000)


@pytest.fixture(scope="module")
def idx(spark):
    d = build_deliveries(fixture_log.raw_lines_df(spark), default_rules(spark)).deliveries
    return d.cache()


def test_listing_hides_ok_and_sorts(idx):
    rows = QY.query_deliveries(idx, C).collect()
    assert len(rows) == 10 and all(r.state != 3 for r in rows)
    assert [r.date_ms for r in rows] == sorted(r.date_ms for r in rows)
    desc = QY.query_deliveries(idx, C, descending=True).collect()
    assert [r.date_ms for r in desc] == sorted((r.date_ms for r in rows), reverse=True)
    assert QY.query_deliveries(idx, C, include_ok=True).count() == 11
    assert QY.query_deliveries(idx, "someone-else").count() == 0


def test_equality_filters(idx):
    assert QY.query_deliveries(idx, C, rcpt_email="fourth@example.net").count() == 4
    assert QY.query_deliveries(idx, C, queue_id=fixture_log.Q_BOUNCED).count() == 1
    assert QY.query_deliveries(idx, C, msg_id="98494.7003.33").count() == 5


def test_time_range_inclusive(idx):
    t = ms("2019 Mar 4 10:00:20.750")
    assert QY.query_deliveries(idx, C, from_ms=t, to_ms=t).count() == 1
    assert QY.query_deliveries(idx, C, to_ms=ms("2019 Mar 8 10:00:20.750")).count() == 6


def test_first_and_last(idx):
    last = QY.query_deliveries(idx, C, last=True).collect()
    assert len(last) == 1 and last[0].state_info == "finally OK"
    first = QY.query_deliveries(idx, C, last=False).collect()
    assert first[0].date_ms == ms("2019 Mar 4 10:00:20.750")
    none = QY.query_deliveries(idx, C, from_ms=ms("2020 Jan 01 00:00:00.000"), last=True).collect()
    assert none == []


def test_grouping(idx):
    g = QY.query_deliveries(idx, C, group_by="msgId").collect()
    keys = {}
    for r in g:
        keys.setdefault(r.group_key, []).append(r)
    assert len(keys) == 3 and max(len(v) for v in keys.values()) == 5
    t = QY.query_deliveries(idx, C, group_by="rcptEmail-and-queueId").collect()
    # outer key is the second property (queue id), inner the first
    assert {r.group_key for r in t} == {r.queue_id for r in t}
    assert all(r.sub_key == r.rcpt_email for r in t)
    one = QY.query_deliveries(idx, C, group_by="msgId", last=True).collect()
    assert len(one) == 3
    latest = {r.group_key: r.date_ms for r in one}
    assert latest["msgId-web-55"] == ms("2019 Mar 11 00:30:00.010")
    pair = QY.query_deliveries(idx, C, group_by=("queueId", "rcptEmail"), last=False).collect()
    assert len(pair) == 3
    with pytest.raises(ValueError):
        QY.query_deliveries(idx, C, group_by="subject")


def test_daily_slices(idx):
    frm, to = ms("2019 Mar 4 00:00:00.000"), ms("2019 Mar 12 00:00:00.000")
    out = QY.query_slices(idx, C, frm, to, 86_400_000, group_by="msgId").collect()
    keys = {}
    for r in out:
        keys.setdefault(r.slice_id, set())
        if r.group_key is not None:
            keys[r.slice_id].add(r.group_key)
    assert [len(keys[i]) for i in range(8)] == [1, 0, 1, 0, 1, 0, 1, 1]
    assert out[0].slice_from == frm


def test_slice_borders(spark):
    df = spark.createDataFrame(
        [("c", 100, "q", "m", "r", "s", "deferred", "x", 0, "try again")],
        "client_id string, date_ms long, queue_id string, msg_id string, rcpt_email string, sender_email string, "
        "status string, info string, state int, state_info string")
    incl = QY.query_slices(df, "c", 0, 250, 100).collect()
    assert sorted(r.slice_id for r in incl if r.date_ms is not None) == [0, 1]
    assert len({r.slice_id for r in incl}) == 3
    half = QY.query_slices(df, "c", 0, 250, 100, boundary="half_open").collect()
    assert sorted(r.slice_id for r in half if r.date_ms is not None) == [1]
    assert QY.slice_count(0, 250, 100) == 3 and QY.slice_count(5, 5, 100) == 0


def test_status_aggregates(idx):
    assert [tuple(r) for r in ST.recipient_counts(idx).collect()] == [(C, 4)]
    assert ST.recipients(idx).count() == 4
    assert [r.client_id for r in ST.client_ids(idx).collect()] == [C]
    ub = ST.unknown_bounces(idx).collect()
    assert len(ub) == 1 and ub[0].client_id == C and ub[0].date_ms is None
    age = ST.index_age(idx).first()
    assert age.index_age_ms == age.oldest_ms == ms("2019 Mar 4 10:00:20.750")
    assert ST.records_by_client(idx).count() == 11
    assert [tuple(r) for r in ST.client_record_counts(idx).collect()] == [(C, 11)]


def test_index_age_of_empty_index_is_now(spark, idx):
    import time

    empty = idx.where("1 = 0")
    before = int(time.time() * 1000)
    age = ST.index_age(empty).first()
    assert age.index_age_ms >= before - 1000 and age.oldest_ms >= before - 1000
    assert [tuple(r) for r in ST.recipient_counts(idx, approx=True).collect()] == [(C, 4)]


def test_slices_match_brute_force(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    schema = ("client_id string, date_ms long, queue_id string, msg_id string, rcpt_email string, "
              "sender_email string, status string, info string, state int, state_info string")

    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.integers(0, 1000), min_size=1, max_size=30), st.integers(0, 500), st.integers(1, 700),
           st.integers(1, 300), st.sampled_from(["inclusive", "half_open"]))
    def check(dates, frm, span, step, boundary):
        to = frm + span
        rows = [("c", d, f"q{i}", f"m{i}", "r", "s", "deferred", "x", 0, "t") for i, d in enumerate(dates)]
        df = spark.createDataFrame(rows, schema)
        out = QY.query_slices(df, "c", frm, to, step, boundary=boundary, sort=False).collect()
        n = QY.slice_count(frm, to, step)
        expected = {}
        for k in range(n):
            lo, hi = frm + k * step, min(frm + (k + 1) * step, to)
            if boundary == "inclusive":
                hit = [d for d in dates if lo <= d <= hi]
            else:
                hit = [d for d in dates if lo <= d < hi or (k == n - 1 and d == to)]
            expected[k] = sorted(hit)
        got = {k: [] for k in range(n)}
        for r in out:
            assert (r.slice_from, r.slice_to) == (frm + r.slice_id * step, min(frm + (r.slice_id + 1) * step, to))
            if r.date_ms is not None:
                got[r.slice_id].append(r.date_ms)
        assert {k: sorted(v) for k, v in got.items()} == expected
        assert {r.slice_id for r in out} == set(range(n))

    check()


def test_slices_scan_their_input_once(spark, scratch):
    df = spark.range(1000).selectExpr(
        "concat('c', id % 3) AS client_id", "id * 1000 AS date_ms", "concat('q', id % 7) AS queue_id", "'m' AS msg_id", "concat('r', id % 5) AS rcpt_email",
        "'s' AS sender_email", "'sent' AS status", "'i' AS info", "cast(id % 3 AS int) AS state", "'x' AS state_info", "date'1970-01-01' AS day")
    df.write.parquet(f"{scratch}/t")
    for kw, rows in (({}, 346), ({"group_by": "queueId", "last": True}, 80), ({"last": False}, 20)):
        out = QY.query_slices(spark.read.parquet(f"{scratch}/t"), "c1", 0, 2_000_000, 100_000, **kw)
        assert len(out.collect()) == rows
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
        assert plan.count("Scan parquet") == 1 and "ReusedExchange" in plan
