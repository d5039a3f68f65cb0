"""Stand-in mail log derived from the driver's ``events`` table.

The driver's tables hold no mail log, so the benchmark and the DuckDB oracle
turn ``events`` into raw log lines of the ``raw_lines`` schema
``(file, rotation, block_start, line_seq, line)``.  This module only writes
text in Postfix's shapes; recognising, correlating and classifying the lines
is left entirely to the library, which knows nothing of how they were made.

Rendering (one or two lines per event, in event order):

* queue id   ``'Q' + lpad(user_id, 6) + 'W' + lpad(week, 7)`` (15 characters)
* ``signup``   -> message-id line (compound id for user_id % 3 = 0), followed by
  a client-id header line when not compound and user_id % 10 <> 9, or when
  compound and event_id % 4 = 0
* ``purchase`` -> sent attempt, plus ``removed`` when event_id % 5 = 0
* ``view``     -> deferred attempt, plus a "queue active" noise line when
  event_id % 7 = 0, else the same line again when event_id % 17 = 0
* ``click``    -> expired (event_id % 4 = 0), removed (= 1), else deferred
* ``error``    -> bounced attempt, plus a client-id line when event_id % 11 = 0,
  else an empty line when event_id % 13 = 0
* line date = event time minus (event_id % 3) seconds, so time may go back;
  every 97th event writes, by turns, the month in full or an unknown month, which does not parse;
  one file per day ``mail.log.<days before 2025-01-01>``; a simulated input
  split every 2,000 events; ``line_seq = 2 * event_id + sub-line``.

The DuckDB twin of this rendering is :func:`duckdb_raw_lines_sql`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES (synthetic data only): reply texts of deferred/bounced attempts,
# picked by event_id % 20.
REPLY_TEXTS = [
    "host mx.example.com said: 421 try again later (in reply to RCPT TO command)",
    "connect to mx.example.com[192.0.2.1]:25: Connection timed out",
    "host mx.example.com said: 552 5.2.2 mailbox full",
    "host mx.example.com refused to talk to me: 554 blocked",
    "connect to mx.example.com[192.0.2.1]:25: Connection refused",
    "Host or domain name not found. Name service error for name=example.invalid type=MX: Host not found, try again",
    "host mx.example.com said: 554 5.7.1 Relay access denied",
    "connect to mx.example.com[192.0.2.1]:25: Network is unreachable",
    "host mx.example.com said: 550 5.7.1 SPF check failed",
    "host mx.example.com said: 421 too many connections from your host",
    "host mx.example.com said: 451 4.3.0 service temporarily unavailable",
    "host mx.example.com said: 450 4.2.0 greylisted, please retry",
    "host mx.example.com said: 550 5.1.1 user unknown",
    "host mx.example.com said: 554 5.7.1 message rejected as spam",
    "host mx.example.com said: 530 5.7.0 authentication required",
    "this email was blacklisted",
    "the remote server said something odd",
    "host mx.example.com said: 553 sorry, that domain isn't in my list of allowed rcpthosts",
    "lost connection with mx.example.com while sending RCPT TO",
    "delivery temporarily suspended: unable to look up host",
]
N_TEXTS = len(REPLY_TEXTS)
EVENTS_PER_SPLIT = 2000
EVENTS_PER_TASK = 50_000
ODD_DATE_EVERY = 97  # by turns a full month name and one that no calendar has: its date does not parse
REPEAT_EVERY = 17  # attempts written twice, as by a doubled log stream


def _s(c) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def raw_lines_from_events(events: DataFrame) -> DataFrame:
    """Render ``events`` as raw mail-log lines (schema of ``raw_lines``)."""
    eid = F.col("event_id")
    uid = F.col("user_id")
    et = F.col("event_type")
    day = F.to_date("ts")
    week = F.floor(F.unix_date(day) / 7).cast("long")
    qid = _cat("Q", F.lpad(_s(uid), 6, "0"), "W", F.lpad(_s(week), 7, "0"))
    shifted = F.col("ts") - F.expr("INTERVAL '1' SECOND") * (eid % 3)
    stamp = F.when(eid % (2 * ODD_DATE_EVERY) == 0, F.date_format(shifted, "yyyy MMMM d HH:mm:ss.SSS")) \
        .when(eid % ODD_DATE_EVERY == 0, F.date_format(shifted, "yyyy 'Brumaire' d HH:mm:ss.SSS")) \
        .otherwise(F.date_format(shifted, "yyyy MMM d HH:mm:ss.SSS"))
    client = _cat("client-", _s(uid % 5))
    rcpt = _cat("user", _s(uid), "-", _s(eid % 3), "@example.com")
    compound = (uid % 3) == 0
    msgid = F.when(compound, _cat("<98494.", _s(eid), ".", _s(eid % 1000), "@", F.col("client"), ">")) \
        .otherwise(_cat("msgId-", _s(eid)))
    reply = F.element_at(F.array(*[F.lit(t) for t in REPLY_TEXTS]), (eid % N_TEXTS + 1).cast("int"))
    first = (F.when(et == "signup", "M").when(et == "purchase", "sent").when(et == "view", "deferred")
             .when((et == "click") & (eid % 4 == 0), "E").when((et == "click") & (eid % 4 == 1), "R")
             .when(et == "click", "deferred").when(et == "error", "bounced"))
    second = (F.when((et == "signup") & ~compound & (uid % 10 != 9), "C")
              .when((et == "signup") & compound & (eid % 4 == 0), "C")
              .when((et == "purchase") & (eid % 5 == 0), "R")
              .when((et == "view") & (eid % 7 == 0), "noise")
              .when((et == "view") & (eid % REPEAT_EVERY == 0), "deferred")
              .when((et == "error") & (eid % 11 == 0), "C")
              .when((et == "error") & (eid % 13 == 0), "empty"))
    rotation = F.datediff(F.lit("2025-01-01").cast("date"), day).cast("int")
    # the parts of a line are made once an event, below the generator, and the text once a line, above it: written
    # out for each kind, the code grows past what the JVM compiles
    parts = events.select(
        "event_id", "user_id", "event_type",
        F.concat(F.lit("mail.log."), rotation.cast("string")).alias("file"),
        rotation.alias("rotation"),
        (F.floor(eid / EVENTS_PER_SPLIT) * 1000000).cast("long").alias("block_start"),
        stamp.alias("stamp"), qid.alias("qid"), client.alias("client"), rcpt.alias("rcpt"))
    lines = parts.select("*", F.inline(F.array(F.struct(F.lit(0).alias("sub"), first.alias("kind")),
                                               F.struct(F.lit(1).alias("sub"), second.alias("kind")))))
    # a line without a date or a queue is none
    lines = lines.where((F.col("kind") == "empty") | (F.col("kind").isNotNull() & F.col("stamp").isNotNull() & F.col("qid").isNotNull()))
    kind, client, rcpt = F.col("kind"), F.col("client"), F.col("rcpt")
    attempt = kind.isin("sent", "deferred", "bounced")
    proc = F.when(attempt, "smtp").when(kind.isin("M", "C"), "cleanup").otherwise("qmgr")
    info = F.when(kind == "sent", _cat("250 2.0.0 Ok: queued as Q", _s(eid))).otherwise(reply)
    body = (F.when(attempt, _cat("to=<", rcpt, ">, relay=mx.example.com[192.0.2.1]:25, delay=1.5, ", "delays=0.1/0/0.4/1, dsn=",
                                 F.when(kind == "sent", "2.0.0").otherwise("4.0.0"), ", status=", kind, " (", info, ")"))
            .when(kind == "M", _cat("message-id=", msgid))
            .when(kind == "C", _cat("info: header client-id: ", client, " from localhost[127.0.0.1]; from=<noreply@", client,
                                    ".example> to=<", rcpt, "> proto=ESMTP helo=<app>"))
            .when(kind == "E", _cat("from=<noreply@", client, ".example>, status=expired, returned to sender"))
            .when(kind == "noise", _cat("from=<noreply@", client, ".example>, size=", _s(eid % 9000 + 500), ", nrcpt=1 (queue active)"))
            .otherwise("removed"))
    line = F.when(kind == "empty", "").otherwise(
        _cat(F.col("stamp"), " mx1 postfix/", proc, "[", _s(eid % 30000 + 1000), "]: ", F.col("qid"), ": ", body))
    return lines.select("file", "rotation", "block_start", (eid * 2 + F.col("sub")).cast("long").alias("line_seq"), line.alias("line"))


def synthetic_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    # Splits of the file say nothing about rows: one row group is one task's, whatever its size, and a row is
    # rendered and parsed in its task.  So rows are dealt evenly (order is carried by columns, never by partitions).
    n = max(spark.sparkContext.defaultParallelism, -(-events.count() // EVENTS_PER_TASK))
    return raw_lines_from_events(events.repartition(n, "event_id", "user_id", "ts"))


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def duckdb_raw_lines_sql(events: str = "events") -> str:
    """The same rendering as DuckDB SQL (the oracle's input)."""
    texts = "[" + ", ".join(_sql_lit(t) for t in REPLY_TEXTS) + "]"
    return f"""
raw_lines AS (
  WITH e AS (
    SELECT event_id AS eid, user_id AS uid, event_type AS et, ts,
      'Q' || lpad(CAST(user_id AS VARCHAR), 6, '0') || 'W'
          || lpad(CAST(CAST(floor((CAST(ts AS DATE) - DATE '1970-01-01') / 7) AS BIGINT) AS VARCHAR), 7, '0') AS qid,
      CASE WHEN event_id % {2 * ODD_DATE_EVERY} = 0
           THEN strftime(ts - to_seconds(CAST(event_id % 3 AS BIGINT)), '%Y %B %-d %H:%M:%S.%g')
           WHEN event_id % {ODD_DATE_EVERY} = 0
           THEN strftime(ts - to_seconds(CAST(event_id % 3 AS BIGINT)), '%Y Brumaire %-d %H:%M:%S.%g')
           ELSE strftime(ts - to_seconds(CAST(event_id % 3 AS BIGINT)), '%Y %b %-d %H:%M:%S.%g') END AS stamp,
      'client-' || CAST(user_id % 5 AS VARCHAR) AS client,
      'user' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 3 AS VARCHAR) || '@example.com' AS rcpt,
      (user_id % 3 = 0) AS compound,
      {texts}[CAST(event_id % {N_TEXTS} + 1 AS INTEGER)] AS reply,
      CAST(event_id % 30000 + 1000 AS VARCHAR) AS pid,
      CAST(DATE '2025-01-01' - CAST(ts AS DATE) AS INTEGER) AS rotation
    FROM {events}
  ), h AS (
    SELECT *,
      stamp || ' mx1 postfix/smtp[' || pid || ']: ' || qid || ': ' AS h_smtp,
      stamp || ' mx1 postfix/cleanup[' || pid || ']: ' || qid || ': ' AS h_cleanup,
      stamp || ' mx1 postfix/qmgr[' || pid || ']: ' || qid || ': ' AS h_qmgr,
      CASE WHEN compound THEN '<98494.' || CAST(eid AS VARCHAR) || '.' || CAST(eid % 1000 AS VARCHAR) || '@' || client || '>'
           ELSE 'msgId-' || CAST(eid AS VARCHAR) END AS msgid
    FROM e
  ), l AS (
    SELECT *,
      h_cleanup || 'message-id=' || msgid AS m_line,
      h_cleanup || 'info: header client-id: ' || client || ' from localhost[127.0.0.1]; from=<noreply@' || client
        || '.example> to=<' || rcpt || '> proto=ESMTP helo=<app>' AS c_line,
      h_qmgr || 'from=<noreply@' || client || '.example>, status=expired, returned to sender' AS e_line,
      h_qmgr || 'removed' AS r_line,
      h_qmgr || 'from=<noreply@' || client || '.example>, size=' || CAST(eid % 9000 + 500 AS VARCHAR)
        || ', nrcpt=1 (queue active)' AS noise,
      h_smtp || 'to=<' || rcpt || '>, relay=mx.example.com[192.0.2.1]:25, delay=1.5, delays=0.1/0/0.4/1, dsn=' AS a_head
    FROM h
  ), two AS (
    SELECT 'mail.log.' || CAST(rotation AS VARCHAR) AS file, rotation,
      CAST(floor(eid / {EVENTS_PER_SPLIT}) * 1000000 AS BIGINT) AS block_start, eid,
      CASE WHEN et = 'signup' THEN m_line
           WHEN et = 'purchase' THEN a_head || '2.0.0, status=sent (250 2.0.0 Ok: queued as Q' || CAST(eid AS VARCHAR) || ')'
           WHEN et = 'view' THEN a_head || '4.0.0, status=deferred (' || reply || ')'
           WHEN et = 'click' AND eid % 4 = 0 THEN e_line
           WHEN et = 'click' AND eid % 4 = 1 THEN r_line
           WHEN et = 'click' THEN a_head || '4.0.0, status=deferred (' || reply || ')'
           WHEN et = 'error' THEN a_head || '4.0.0, status=bounced (' || reply || ')'
      END AS line0,
      CASE WHEN et = 'signup' AND NOT compound AND uid % 10 <> 9 THEN c_line
           WHEN et = 'signup' AND compound AND eid % 4 = 0 THEN c_line
           WHEN et = 'purchase' AND eid % 5 = 0 THEN r_line
           WHEN et = 'view' AND eid % 7 = 0 THEN noise
           WHEN et = 'view' AND eid % {REPEAT_EVERY} = 0 THEN a_head || '4.0.0, status=deferred (' || reply || ')'
           WHEN et = 'error' AND eid % 11 = 0 THEN c_line
           WHEN et = 'error' AND eid % 13 = 0 THEN ''
      END AS line1
    FROM l
  )
  SELECT file, rotation, block_start, CAST(eid * 2 AS BIGINT) AS line_seq, line0 AS line FROM two WHERE line0 IS NOT NULL
  UNION ALL
  SELECT file, rotation, block_start, CAST(eid * 2 + 1 AS BIGINT) AS line_seq, line1 AS line FROM two WHERE line1 IS NOT NULL
)"""
