"""Bounce classification (CLS-1..5).

The rule list is configuration (tens of rows), so it is read once on the
driver and compiled into a single code-generated ``CASE WHEN`` over
``lower(info)`` -- no join, no UDF.  The first rule in priority order whose
regex is *found* in the text wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.columns import once


def rule_order(rules: DataFrame, hits: DataFrame | None = None) -> list[dict]:
    """CLS-3: soft rules before hard ones, then by hit count, then document order.

    ``hits`` (rule_id, hits) -- e.g. the previous run's :func:`bounce_rule_hits`
    -- replaces the rule list's own counters.  Both are rule-sized tables
    (configuration), so they are collected and ordered on the driver."""
    rows = [r.asDict() for r in rules.select("rule_id", "type", "category", "regex", "hits",
                                             "default_order").collect()]
    if hits is not None:
        counts = {r["rule_id"]: int(r["hits"] or 0) for r in hits.select("rule_id", "hits").collect()}
        for r in rows:
            r["hits"] = counts.get(r["rule_id"], 0)
    rows.sort(key=lambda r: (r["type"], r["hits"] or 0, r["default_order"]), reverse=True)
    return [{k: r[k] for k in ("rule_id", "type", "category", "regex")} for r in rows]


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_index(info_lc: str, ordered: list[dict]):
    """Id of the first rule (in priority order) whose regex is found in the
    lower-cased text -- one SQL CASE (regexes as escaped literals)."""
    if not ordered:
        return F.lit(None).cast("int")
    whens = " ".join(f"WHEN {info_lc} RLIKE {_sql_str(r['regex'])} THEN {int(r['rule_id'])}" for r in ordered)
    return F.expr(f"CASE {whens} END")


def classify(records: DataFrame, rules: DataFrame, hits: DataFrame | None = None,
             keep_rule_id: bool = False) -> DataFrame:
    """CLS-1/2: add ``state`` and ``state_info`` (and optionally ``rule_id``)."""
    ordered = rule_order(rules, hits)
    # The rules are tried once per row, whatever a query filters by: a condition on the state, pushed below its
    # CASE, would hold the whole list of rules once for each of its branches, and the JVM runs so large a method uncompiled.
    rule = F.when(~F.col("status").isin("sent", "expired"), _rule_index("_info_lc", ordered))
    staged = records.withColumn("_info_lc", F.lower(F.col("info"))).select("*", once(_rule_id=rule)).drop("_info_lc")
    # state/state_info read the rule id computed once above
    state, state_info = _classification_from_id(ordered)
    out = staged.select("*", once(_state=state, _state_info=state_info)).withColumns(
        {"state": F.col("_state"), "state_info": F.col("_state_info")}).drop("_state", "_state_info")
    if keep_rule_id:
        return out.withColumnRenamed("_rule_id", "rule_id")
    return out.drop("_rule_id")


def _classification_from_id(ordered: list[dict]):
    """state / state_info from status, the deferral flag and the rule id.

    Written as two SQL CASE expressions over literals (one JVM call each
    instead of one per branch node)."""
    head = ("WHEN status = 'sent' AND coalesce(has_been_deferred, false) THEN {fin} "
            "WHEN status = 'sent' THEN {ok} WHEN status = 'expired' THEN {exp} "
            "WHEN _rule_id IS NULL THEN {und} ")
    state = "CASE " + head.format(fin=P.STATE_FINALLY_OK, ok=P.STATE_OK, exp=P.STATE_SOFT, und=P.STATE_UNKNOWN)
    info = "CASE " + head.format(fin=_sql_str(P.INFO_FINALLY_OK), ok=_sql_str(P.INFO_OK),
                                 exp=_sql_str(P.INFO_EXPIRED), und=_sql_str(P.INFO_UNDECIDED))
    for r in ordered:
        st = P.STATE_SOFT if r["type"] == "soft" else P.STATE_HARD
        state += f"WHEN _rule_id = {int(r['rule_id'])} THEN {st} "
        info += f"WHEN _rule_id = {int(r['rule_id'])} THEN {_sql_str(r['category'])} "
    return F.expr(state + "END").cast("int"), F.expr(info + "END")


def bounce_rule_hits(classified: DataFrame, rules: DataFrame) -> DataFrame:
    """CLS-4: how many records each rule classified; rules without hits show 0.

    ``classified`` must carry ``rule_id`` (``classify(..., keep_rule_id=True)``).
    Counting is a partial aggregation; the join is between two rule-sized
    tables."""
    counts = classified.where(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(F.count("*").alias("n"))
    return (
        rules.select("rule_id", "type", "default_order", "category")
        .join(counts, "rule_id", "left")
        .select("rule_id", "type", F.coalesce("n", F.lit(0)).cast("long").alias("hits"),
                "default_order", "category")
    )


def reclassify(deliveries: DataFrame, rules: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """CLS-5: re-run the rules over stored records after the list changed.

    Sent (3, 4) and expired records keep their class; only bounces and
    deferrals are matched again."""
    cols = deliveries.columns
    tmp = deliveries.withColumn("has_been_deferred", F.col("state") == P.STATE_FINALLY_OK)
    out = classify(tmp.drop("state", "state_info"), rules, hits)
    return out.select(*cols)
