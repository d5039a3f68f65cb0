"""DuckDB SQL twins of the registered queries (the correctness oracle).

The oracle deliberately uses the plain textbook form -- one window per queue
id over the whole queue -- rather than the library's split-wise scan, so the
two are independent derivations of the same automaton.  Tables are the
driver's pre-registered views; the mail log is rendered from ``events`` by
``duckdb_raw_lines_sql`` exactly as the library's stand-in input.
"""

from __future__ import annotations

from relaylens.functions import patterns as P
from relaylens.sources.default_rules import DEFAULT_RULES
from stand_in_log import duckdb_raw_lines_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_in_priority():
    n = len(DEFAULT_RULES)
    rows = []
    for i, (t, c, pats) in enumerate(DEFAULT_RULES):
        regex = "(" + "|".join("(" + p + ")" for p in pats) + ")"
        rows.append({"rule_id": i + 1, "type": t, "category": c, "default_order": n - i, "regex": regex})
    return rows


def priority(rows, hits=None):
    hits = hits or {}
    return sorted(rows, key=lambda r: (r["type"], hits.get(r["rule_id"], 0), r["default_order"]), reverse=True)


def rule_case(rows) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(info), {q(r['regex'])}) THEN {r['rule_id']}" for r in rows)
    return f"CASE WHEN status IN ('sent', 'expired') THEN NULL {whens} END"


def classified_sql(rows, source: str = "rec") -> str:
    ids = {r["rule_id"]: r for r in rows}
    st = " ".join(f"WHEN rule_id = {i} THEN {0 if r['type'] == 'soft' else 1}" for i, r in ids.items())
    inf = " ".join(f"WHEN rule_id = {i} THEN {q(r['category'])}" for i, r in ids.items())
    return f"""
  SELECT *,
    CASE WHEN status = 'sent' AND has_been_deferred THEN 4 WHEN status = 'sent' THEN 3
         WHEN status = 'expired' THEN 0 WHEN rule_id IS NULL THEN 2 {st} END AS state,
    CASE WHEN status = 'sent' AND has_been_deferred THEN 'finally OK' WHEN status = 'sent' THEN 'OK'
         WHEN status = 'expired' THEN 'expired, returned to sender'
         WHEN rule_id IS NULL THEN 'unable to decide on type of bounce' {inf} END AS state_info
  FROM (SELECT *, {rule_case(rows)} AS rule_id FROM {source})"""


def _x(rx: str, g: int) -> str:
    return f"regexp_extract(line, {q(rx)}, {g})"


ORDER = "rotation DESC, file, block_start, line_seq"


def _with_expiry(parsed: str, ttl_ms: int) -> str:
    """``parsed`` with a removal before each line at which its queue has expired by log time."""
    cols = "file, rotation, block_start, line_seq, kind, queue_id, event_ms, rcpt_email, sender_email, status, info, msg_id_raw, msg_id, client_id"
    none = ", ".join(["NULL"] * 8)
    own = (f"CASE WHEN kind IN ('A', 'E') THEN event_ms ELSE epoch_ms(try_strptime(regexp_extract(line, {q(P.LINE_DATE_RE)}, 1), "
           "['%Y %b %d %H:%M:%S.%g', '%Y %B %d %H:%M:%S.%g'])) END")
    return f"""{parsed.replace('parsed AS (', 'parsed0 AS (').replace('    msg_id_raw,', f'    {own} AS own_ms, msg_id_raw,', 1)},
timed AS (SELECT *, max(own_ms) OVER (ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS log_ms FROM parsed0),
late AS (
  SELECT *, log_ms - last_value(COALESCE(own_ms, log_ms) IGNORE NULLS) OVER (
    PARTITION BY queue_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {ttl_ms} AS late FROM timed),
parsed AS (
  SELECT {cols} FROM late
  UNION ALL SELECT file, rotation, block_start, line_seq - 0.5, 'R', queue_id, {none} FROM late WHERE late),
"""


def base_ctes(hits=None, ttl_ms: int | None = None) -> str:
    """raw_lines -> parsed -> traced -> rec -> cls -> deliveries (set)."""
    whole = _base_ctes(hits)
    if ttl_ms is None:
        return whole
    a, b = whole.index("parsed AS ("), whole.index("lived AS (")
    return whole[:a] + _with_expiry(whole[a:b].rstrip().rstrip(","), ttl_ms) + whole[b:]


def _base_ctes(hits=None) -> str:
    A, M, C, E, R = P.ATTEMPT_RE, P.MESSAGE_ID_RE, P.CLIENT_ID_RE, P.EXPIRED_RE, P.REMOVED_RE
    cm = q(P.COMPOUND_MSG_ID_RE)
    rows = priority(_rules_in_priority(), hits)
    return f"""WITH {duckdb_raw_lines_sql()},
kinds AS (
  SELECT *, CASE WHEN regexp_matches(line, {q(A)}) THEN 'A' WHEN regexp_matches(line, {q(M)}) THEN 'M'
                 WHEN regexp_matches(line, {q(C)}) THEN 'C' WHEN regexp_matches(line, {q(E)}) THEN 'E'
                 WHEN regexp_matches(line, {q(R)}) THEN 'R' END AS kind
  FROM raw_lines),
fields AS (
  SELECT file, rotation, block_start, line_seq, kind,
    CASE kind WHEN 'A' THEN {_x(A, 2)} WHEN 'M' THEN {_x(M, 1)} WHEN 'C' THEN {_x(C, 1)}
              WHEN 'E' THEN {_x(E, 2)} WHEN 'R' THEN {_x(R, 1)} END AS queue_id,
    epoch_ms(try_strptime(CASE kind WHEN 'A' THEN {_x(A, 1)} WHEN 'E' THEN {_x(E, 1)} END,
                          ['%Y %b %d %H:%M:%S.%g', '%Y %B %d %H:%M:%S.%g'])) AS event_ms,
    CASE WHEN kind = 'A' THEN {_x(A, 3)} END AS rcpt_email,
    CASE WHEN kind = 'E' THEN {_x(E, 3)} END AS sender_email,
    CASE kind WHEN 'A' THEN {_x(A, 4)} WHEN 'E' THEN {_x(E, 4)} END AS status,
    CASE kind WHEN 'A' THEN {_x(A, 5)} WHEN 'E' THEN {_x(E, 5)} END AS info,
    CASE WHEN kind = 'M' THEN {_x(M, 2)} END AS msg_id_raw,
    CASE WHEN kind = 'C' THEN {_x(C, 2)} END AS cid_line,
    line
  FROM kinds WHERE kind IS NOT NULL),
parsed AS (
  SELECT file, rotation, block_start, line_seq, kind, queue_id, event_ms, rcpt_email, sender_email, status, info,
    msg_id_raw,
    CASE WHEN regexp_matches(msg_id_raw, {cm}) THEN regexp_extract(msg_id_raw, {cm}, 1) ELSE msg_id_raw END AS msg_id,
    CASE WHEN kind = 'M' THEN (CASE WHEN regexp_matches(msg_id_raw, {cm}) THEN regexp_extract(msg_id_raw, {cm}, 2) END)
         ELSE cid_line END AS client_id
  FROM fields WHERE kind NOT IN ('A', 'E') OR event_ms IS NOT NULL),
lived AS (
  SELECT *, sum(CASE WHEN kind = 'M' THEN 1 ELSE 0 END) OVER (PARTITION BY queue_id ORDER BY {ORDER}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life
  FROM parsed),
s1 AS (
  SELECT *,
    first_value(CASE WHEN kind IN ('M', 'C') THEN client_id END IGNORE NULLS) OVER (wl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cid_at,
    first_value(CASE WHEN kind IN ('M', 'C') THEN client_id END IGNORE NULLS) OVER (wl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cid_before,
    coalesce(bool_or(kind = 'A' AND status = 'deferred') OVER (wl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS def_before,
    first_value(CASE WHEN kind = 'A' AND status = 'deferred' THEN rcpt_email END IGNORE NULLS) OVER (wl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS drcpt,
    first_value(CASE WHEN kind = 'M' THEN msg_id END IGNORE NULLS) OVER (wl ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS life_msg
  FROM lived
  WINDOW wl AS (PARTITION BY queue_id, life ORDER BY {ORDER})),
traced AS (
  SELECT *, life > 0 AND NOT coalesce(bool_or(kind = 'R' OR (kind IN ('A', 'E') AND cid_at IS NULL))
            OVER (PARTITION BY queue_id, life ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS alive
  FROM s1),
rec AS (
  SELECT cid_at AS client_id, event_ms AS date_ms, queue_id, life_msg AS msg_id,
    CASE WHEN kind = 'E' THEN drcpt ELSE rcpt_email END AS rcpt_email,
    CASE WHEN kind = 'E' THEN sender_email ELSE 'unknown' END AS sender_email,
    status, info, (kind = 'E' OR def_before) AS has_been_deferred, file AS source_file
  FROM traced
  WHERE alive AND cid_at IS NOT NULL AND (kind = 'A' OR (kind = 'E' AND def_before AND drcpt IS NOT NULL))),
cls AS ({classified_sql(rows)}),
deliveries AS (
  SELECT DISTINCT client_id, date_ms, queue_id, msg_id, rcpt_email, sender_email, status, info,
         CAST(state AS INTEGER) AS state, state_info
  FROM cls)
"""


RECORD = "client_id, date_ms, queue_id, msg_id, rcpt_email, sender_email, status, info, state, state_info"
TIE = ("concat_ws(',', coalesce(queue_id, 'null'), coalesce(msg_id, 'null'), coalesce(rcpt_email, 'null'), "
       "coalesce(sender_email, 'null'), coalesce(status, 'null'), coalesce(info, 'null'), "
       "coalesce(CAST(state AS VARCHAR), 'null'), coalesce(state_info, 'null'))")
