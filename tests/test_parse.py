from pyspark.sql import functions as F

from relaylens.operators.parse import parse_lines, rejected_lines
from tests import fixture_log


def _parse(spark, lines):
    df = spark.createDataFrame([("f", 1, 0, i, l) for i, l in enumerate(lines)],
                               "file string, rotation int, block_start long, line_seq long, line string")
    return {r.line_seq: r for r in parse_lines(df).collect()}


def test_fixture_counts(spark):
    p = parse_lines(fixture_log.raw_lines_df(spark))
    kinds = {r["kind"]: r["count"] for r in p.groupBy("kind").count().collect()}
    # 10 attempts, 1 expired, 1 client-id, 4 message-ids, 3 removed
    assert kinds == {"A": 10, "E": 1, "C": 1, "M": 4, "R": 3}


def test_five_shapes(spark):
    lines = [
        "2019 Mar 16 16:05:07.123 h postfix/smtp[1]: A1b2C3d4E5f6G7h: to=<a@b.cz>, relay=x, dsn=2.0.0, "
        "status=sent (250 ok (nested))",
        "2019 Mar 16 16:05:07.123 h postfix/cleanup[1]: A1b2C3d4E5f6G7h: message-id=<98494.1.2@client-a>",
        "2019 Mar 16 16:05:07.123 h postfix/cleanup[1]: A1b2C3d4E5f6G7h: info: header client-id: cl-b from x",
        "2019 Mar 5 16:05:07.123 h postfix/qmgr[1]: A1b2C3d4E5f6G7h: from=<s@b.cz>, status=expired, returned to sender",
        "2019 Mar 16 16:05:07.123 h postfix/qmgr[1]: A1b2C3d4E5f6G7h: removed",
        "2019 Mar 16 16:05:07.123 h postfix/cleanup[1]: A1b2C3d4E5f6G7h: message-id=msgId-77",
    ]
    p = _parse(spark, lines)
    a = p[0]
    assert (a.kind, a.queue_id, a.rcpt_email, a.status, a.info) == ("A", "A1b2C3d4E5f6G7h", "a@b.cz", "sent",
                                                                    "250 ok (nested)")
    assert a.event_ms == 1552752307123
    assert (p[1].kind, p[1].msg_id, p[1].client_id, p[1].msg_id_raw) == ("M", "98494.1.2", "client-a",
                                                                         "<98494.1.2@client-a>")
    assert (p[2].kind, p[2].client_id) == ("C", "cl-b")
    assert (p[3].kind, p[3].sender_email, p[3].status, p[3].info) == ("E", "s@b.cz", "expired", "returned to sender")
    assert p[4].kind == "R"
    assert (p[5].msg_id, p[5].client_id) == ("msgId-77", None)


def test_non_matching_lines_dropped(spark):
    lines = [
        "",
        "2019 Mar 16 16:05:07.123 h postfix/smtpd[1]: connect from x[1.2.3.4]",
        "2019 Mar 16 16:05:07.123 h postfix/smtp[1]: A1b2C3d4E5f6G7h: to=<nobody>, status=sent (x)",  # no @
        "2019 Mar 16 16:05:07.123 h postfix/qmgr[1]: A1b2C3d4E5f6G7h: from=<>, status=expired, returned",  # null sender
        "2019 Mar 16 16:05:07.123 h postfix/qmgr[1]: SHORTID: removed",
        "2019 Mar 16 16:05:07.123 h postfix/qmgr[1]: A1b2C3d4E5f6G7h: from=<a@b>, size=1, nrcpt=1 (queue active)",
    ]
    assert _parse(spark, lines) == {}


def test_long_queue_id_uses_last_15_for_attempts(spark):
    line = ("2019 Mar 16 16:05:07.123 h postfix/smtp[1]: XXA1b2C3d4E5f6G7h: to=<a@b.cz>, "
            "status=deferred (later)")
    p = _parse(spark, [line])
    assert p[0].queue_id == "A1b2C3d4E5f6G7h"


def test_separator_in_line_takes_exact_path(spark):
    line = ("2019 Mar 16 16:05:07.123 h postfix/smtp[1]: A1b2C3d4E5f6G7h: to=<a@b.cz>, "
            "status=bounced (odd \u0001 text)")
    p = _parse(spark, [line])
    assert (p[0].kind, p[0].info, p[0].rcpt_email) == ("A", "odd \u0001 text", "a@b.cz")


def _dated(spark, dates, zone="UTC"):
    lines = [f"{d} h postfix/smtp[1]: A1b2C3d4E5f6G7h: to=<a@b.cz>, status=sent (ok)" for d in dates]
    df = spark.createDataFrame([("f", 1, 0, i, l) for i, l in enumerate(lines)], "file string, rotation int, block_start long, "
                                                                               "line_seq long, line string")
    return {r.line_seq: r.event_ts_text for r in parse_lines(df, zone).select(
        "line_seq", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_ts_text")).collect()}, rejected_lines(df).collect()


def test_dates_full_lenient_and_bad(spark):
    good, bad = _dated(spark, ["2019 June 16 16:05:07.123", "2019 jun 5 16:05:07.123", "2019 Feb 29 16:05:07.123", "2020 December 32 24:00:61.000",
                               "2019 Brumaire 1 16:05:07.123", "2019 Juneau 1 16:05:07.123", "2019 Jun 1 16:05:07,123"])
    assert good == {0: "2019-06-16 16:05:07.123", 1: "2019-06-05 16:05:07.123", 2: "2019-03-01 16:05:07.123", 3: "2021-01-02 00:01:01.000"}
    assert sorted(r.line_seq for r in bad) == [4, 5, 6] and {r.reason for r in bad} == {"unparsable date"}


def test_time_zone_argument(spark):
    line = "2019 Jul 16 16:05:07.123 h postfix/smtp[1]: A1b2C3d4E5f6G7h: to=<a@b.cz>, status=sent (ok)"
    df = spark.createDataFrame([("f", 1, 0, 0, line)], "file string, rotation int, block_start long, "
                                                       "line_seq long, line string")
    utc = parse_lines(df).first().event_ms
    prague = parse_lines(df, time_zone="Europe/Prague").first().event_ms
    assert utc - prague == 2 * 3600 * 1000
    assert parse_lines(df).select(F.col("event_ts").cast("long")).first()[0] == utc // 1000
