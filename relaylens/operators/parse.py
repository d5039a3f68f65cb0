"""Line recognition (PAR-1..8): raw log lines -> typed, flat ``parsed_lines``.

All work is JVM-side column expressions inside one code-generated stage:

* a cheap substring test guards every regex (most lines of a busy mail log
  are connect/disconnect noise and never reach a regex engine);
* each candidate kind costs exactly one regex evaluation: ``regexp_replace``
  rewrites a matching line into its capture groups joined by U+0001, which a
  ``split`` then indexes.  Lines that themselves contain U+0001 take the exact
  ``rlike``/``regexp_extract`` path instead, so results never depend on it;
* unmatched lines are dropped here, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import once as _once

_SEP = "\u0001"

# kind -> (pattern, number of groups, necessary substrings, suffix or None)
_KINDS = [
    ("A", P.ATTEMPT_RE, 5, [": to=<", "status="], None),
    ("M", P.MESSAGE_ID_RE, 2, [": message-id="], None),
    ("C", P.CLIENT_ID_RE, 2, [": info: header client-id: "], None),
    ("E", P.EXPIRED_RE, 5, [": from=<", "status=expired, "], None),
    ("R", P.REMOVED_RE, 1, [], ": removed"),
]


def _prefilter(line: Column, needles, suffix) -> Column:
    cond = F.lit(True)
    for n in needles:
        cond = cond & line.contains(n)
    if suffix is not None:
        cond = cond & line.endswith(suffix)
    return cond


def _template(n: int) -> str:
    return "".join(f"{_SEP}${i}" for i in range(1, n + 1))


def _date_parts(date_text: Column) -> Column:
    """Year, month, day, hour, minute, second and milliseconds as text; NULL if the text has another shape."""
    return F.when(date_text.rlike(P.LOG_DATE_RE), F.split(date_text, r"[ :.]"))


def _parts_ms(parts: Column, time_zone: str) -> Column:
    months = F.create_map(*[F.lit(x) for i, m in enumerate(P.MONTHS) for x in
                            ([m.lower(), i + 1] if len(m) == 3 else [m.lower(), i + 1, m[:3].lower(), i + 1])])
    month = months[F.lower(parts.getItem(1))]

    def number(i):
        return parts.getItem(i).try_cast("long")

    days = F.unix_date(F.make_date(number(0).cast("int"), month, F.lit(1))).cast("long") + number(2) - 1
    local = (((days * 24 + number(3)) * 60 + number(4)) * 60 + number(5)) * 1000 + number(6)
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), time_zone))


def parse_date_ms(date_text: Column, time_zone: str = "UTC") -> Column:
    """Log date text -> epoch milliseconds in ``time_zone``; NULL if the month
    is unknown or the text has another shape.  Days and times out of range run
    over, as in a lenient calendar; the session time zone plays no part."""
    return _parts_ms(_date_parts(date_text), time_zone)


def may_matter(line: Column) -> Column:
    """Whether a line holds the substrings of some kind; no other line can be recognised."""
    found = F.lit(False)
    for _, _, _, needles, suffix in _KINDS:
        found = found | _prefilter(line, needles, suffix)
    return found


def _recognise(raw: DataFrame) -> DataFrame:
    """Recognised lines with ``kind`` and ``_g``, the capture groups of its pattern from index 1 on.

    Every step is a small operator: the JVM runs a generated method of more than 8000 bytes uncompiled."""
    line = F.col("line")
    clean = ~line.contains(_SEP)
    # 1) one regex evaluation per kind whose substrings are present
    staged = raw.select(*raw.columns, _once(**{
        f"_r{kind}": F.when(_prefilter(line, needles, suffix) & clean, F.regexp_replace(line, rx, _template(n)))
        for kind, rx, n, needles, suffix in _KINDS}))
    # 2) the first kind that matches; only lines containing the separator take the exact regexp path
    kind, hit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rx, _, needles, suffix in reversed(_KINDS):
        found = F.col(f"_r{k}").startswith(_SEP)
        kind = F.when(F.when(clean, found).otherwise(_prefilter(line, needles, suffix) & line.rlike(rx)), F.lit(k)).otherwise(kind)
        hit = F.when(found, F.col(f"_r{k}")).otherwise(hit)
    found = staged.select(*raw.columns, _once(kind=kind, _hit=hit)).where(F.col("kind").isNotNull())
    # 3) the capture groups; past a pattern's last group, that one again
    rx = F.element_at(F.create_map(*[F.lit(x) for k in _KINDS for x in k[:2]]), F.col("kind"))
    last = F.element_at(F.create_map(*[F.lit(x) for k in _KINDS for x in (k[0], k[2])]), F.col("kind"))
    exact = found.select("*", _once(_rx=F.when(F.col("_hit").isNull(), rx), _n=last))
    groups = F.when(F.col("_hit").isNotNull(), F.split("_hit", _SEP, -1)).otherwise(
        F.array(F.lit(""), *[F.call_function("regexp_extract", line, F.col("_rx"), F.least(F.lit(i), F.col("_n"))) for i in range(1, 6)]))
    return exact.select(*raw.columns, "kind", _once(_g=groups))


def _field(spec: dict[str, int]) -> Column:
    """Pick capture group ``spec[kind]`` of the row's kind (NULL if absent)."""
    out = None
    for kind, i in spec.items():
        g = F.col("_g").getItem(i)
        out = F.when(F.col("kind") == kind, g) if out is None else out.when(F.col("kind") == kind, g)
    return out


def _typed(recognised: DataFrame, time_zone: str, log_dates: bool) -> DataFrame:
    kind = F.col("kind")
    msg_raw = _field({"M": 2})
    date_text = _field({"A": 1, "E": 1})
    if log_dates:
        date_text = F.coalesce(date_text, F.regexp_extract("line", P.LINE_DATE_RE, 1))
    recognised = recognised.select("*", _once(_date=_date_parts(date_text)))
    recognised = recognised.select("*", _once(line_ms=_parts_ms(F.col("_date"), time_zone)))
    dates = ["line_ms"] if log_dates else []
    out = recognised.select(
        "file", "rotation", "block_start", "line_seq", "kind",
        _field({"A": 2, "M": 1, "C": 1, "E": 2, "R": 1}).alias("queue_id"),
        F.when(kind.isin("A", "E"), F.col("line_ms")).alias("event_ms"),
        _field({"A": 3}).alias("rcpt_email"),
        _field({"E": 3}).alias("sender_email"),
        _field({"A": 4, "E": 4}).alias("status"),
        _field({"A": 5, "E": 5}).alias("info"),
        msg_raw.alias("msg_id_raw"),
        F.when(kind == "C", _field({"C": 2})).alias("_cid_line"),
        "line", *dates,
    )
    compound = F.col("msg_id_raw").rlike(P.COMPOUND_MSG_ID_RE)
    return (
        out.withColumn("event_ts", F.timestamp_millis("event_ms"))
        .withColumn("msg_id", F.when(compound, F.regexp_extract("msg_id_raw", P.COMPOUND_MSG_ID_RE, 1))
                    .otherwise(F.col("msg_id_raw")))
        .withColumn("client_id", F.when(kind == "M", F.when(compound, F.regexp_extract(
            "msg_id_raw", P.COMPOUND_MSG_ID_RE, 2))).otherwise(F.col("_cid_line")))
    )


PARSED_COLUMNS = [
    "file", "rotation", "block_start", "line_seq", "kind", "queue_id", "event_ms", "event_ts",
    "rcpt_email", "sender_email", "status", "info", "msg_id_raw", "msg_id", "client_id",
]


def recognised_lines(raw_lines: DataFrame, time_zone: str = "UTC", log_dates: bool = False) -> DataFrame:
    """All recognised lines with their fields, those with an unusable date (NULL ``event_ms``) included.

    With ``log_dates`` also ``line_ms``, the date at the start of a line of any kind."""
    out = _typed(_recognise(raw_lines), time_zone, log_dates)
    return out.select(*[c for c in out.columns if c != "line_ms"], *(["line_ms"] if log_dates else []))


def _dated():
    return ~F.col("kind").isin("A", "E") | F.col("event_ms").isNotNull()


def usable(recognised: DataFrame) -> DataFrame:
    return recognised.where(_dated()).select(*PARSED_COLUMNS, *[c for c in ("line_ms",) if c in recognised.columns])


def rejected(recognised: DataFrame) -> DataFrame:
    return recognised.where(~_dated()).select("file", "line_seq", "queue_id", F.lit("unparsable date").alias("reason"), "line")


def parse_lines(raw_lines: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Recognise the five relevant line kinds; drop all other lines.

    Attempt/expired lines whose date does not parse are left out here and
    reported by :func:`rejected_lines` (the job continues and keeps them in a table)."""
    return usable(recognised_lines(raw_lines, time_zone))


def rejected_lines(raw_lines: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """Recognised lines that cannot be used: attempt/expired with a bad date."""
    return rejected(recognised_lines(raw_lines, time_zone))
