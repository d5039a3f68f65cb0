"""The rule list is tried once per record, also below a condition on the state."""

from relaylens.operators.classify import classify
from relaylens.plans.pipeline import distinct_records, to_delivery_rows
from relaylens.sources.rules import default_rules

RECORDS = ("client_id string, date_ms long, queue_id string, msg_id string, rcpt_email string, sender_email string, "
           "status string, info string, has_been_deferred boolean, source_file string")


def test_conditions_on_the_state_do_not_repeat_the_rules(spark):
    rules = default_rules(spark)
    rows = [("c", i, "q", "m", "r", "s", status, info, False, "f") for i, (status, info) in enumerate(
        [("sent", "ok"), ("bounced", "something odd"), ("bounced", "554 spam"), ("deferred", None)])]
    found = distinct_records(to_delivery_rows(classify(spark.createDataFrame(rows, RECORDS), rules)))
    for condition, dates in (("state = 2", {1, 3}), ("state <> 3", {1, 2, 3})):
        chosen = found.where(condition)
        assert {r.date_ms for r in chosen.collect()} == dates
        assert chosen._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= rules.count()
