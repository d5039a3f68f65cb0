"""A mail log of one client, made for these tests.

Four queues: one delivered at once; one bounced; one deferred four times and then expired; one deferred three times, then
delivered and never removed.  Time goes backwards between queues, lines share a millisecond, and there is an
empty line.  Expected, worked out by hand: 11 records (1 + 1 + 5 + 4), 10 without the one that is OK at once;
lines of kind A 10, E 1, C 1, M 4, R 3; one queue stays open.
"""

CLIENT = "billing-app"
Q_OK, Q_BOUNCED, Q_EXPIRED, Q_LATE = "A1b2C3d4E5f6G7h", "B9k8J7i6H5g4F3e", "C5m4N3b2V1c0X9z", "D7s6A5q4W3e2R1t"
TIMED_OUT = "connect to mx.example.net[198.51.100.7]:25: network connection timed out"


def _line(date, process, queue, rest):
    return f"2019 {date} edge3 postfix/{process}[815]: {queue}: {rest}"


def _attempt(date, queue, rcpt, status, info):
    return _line(date, "smtp", queue, f"to=<{rcpt}>, relay=none, delay=4, dsn=0.0.0, status={status} ({info})")


def lines():
    out = [
        _line("Mar 12 09:10:05.250", "smtpd", Q_OK, "client=app.example.org[198.51.100.3]"),
        _line("Mar 12 09:10:05.250", "cleanup", Q_OK, f"message-id=<98494.7001.11@{CLIENT}>"),
        _attempt("Mar 12 09:10:05.250", Q_OK, "first@example.net", "sent", "250 accepted"),
        _line("Mar 12 09:10:05.250", "qmgr", Q_OK, "removed"),
        _line("Mar 6 08:01:30.500", "cleanup", Q_BOUNCED, f"message-id=<98494.7002.22@{CLIENT}>"),
        _line("Mar 6 08:01:30.500", "qmgr", Q_BOUNCED, "from=<bills@example.org>, size=700, nrcpt=1 (queue active)"),
        _attempt("Mar 6 08:01:30.500", Q_BOUNCED, "second@example.net", "bounced", "this email was blacklisted"),
        _line("Mar 6 08:01:30.500", "bounce", Q_BOUNCED, "sender non-delivery notification: 0123456789A"),
        _line("Mar 6 08:01:30.500", "qmgr", Q_BOUNCED, "removed"),
        _line("Mar 4 10:00:00.750", "cleanup", Q_EXPIRED, f"message-id=<98494.7003.33@{CLIENT}>"),
    ]
    out += [_attempt(f"Mar 4 {t}.750", Q_EXPIRED, "third@example.net", "deferred", TIMED_OUT)
            for t in ("10:00:20", "10:20:20", "11:00:20", "12:20:20")]
    out += [
        _line("Mar 8 10:00:20.750", "qmgr", Q_EXPIRED, "from=<bills@example.org>, status=expired, returned to sender"),
        _line("Mar 8 10:00:20.750", "qmgr", Q_EXPIRED, "removed"),
        "",
        _line("Mar 10 22:15:00.010", "cleanup", Q_LATE, "message-id=msgId-web-55"),
        _line("Mar 10 22:15:00.010", "cleanup", Q_LATE, f"info: header client-id: {CLIENT} from app.example.org[198.51.100.3]; "
              "from=<bills@example.org> to=<fourth@example.net> proto=ESMTP helo=<app>"),
    ]
    out += [_attempt(f"Mar 10 {t}.010", Q_LATE, "fourth@example.net", "deferred", TIMED_OUT) for t in ("22:15:30", "22:45:30", "23:59:30")]
    out.append(_attempt("Mar 11 00:30:00.010", Q_LATE, "fourth@example.net", "sent", "250 accepted"))
    return out


def raw_lines_df(spark, file="mail.log.1", rotation=1, split_every=None):
    rows = []
    for i, line in enumerate(lines()):
        block = (i // split_every) * 10_000 if split_every else 0
        rows.append((file, rotation, block, i, line))
    return spark.createDataFrame(rows, "file string, rotation int, block_start long, line_seq long, line string")
