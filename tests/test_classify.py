import os

import pytest

from relaylens.operators.classify import bounce_rule_hits, classify, reclassify, rule_order
from relaylens.sources.default_rules import DEFAULT_RULES
from relaylens.sources.rules import (InvalidRuleList, default_rules, load_bounce_rules, validate_bounce_rules,
                                     write_rules_xml)


def _classify(spark, items, rules=None, hits=None):
    df = spark.createDataFrame(items, "i int, status string, info string, has_been_deferred boolean")
    out = classify(df, rules if rules is not None else default_rules(spark), hits, keep_rule_id=True)
    return {r.i: (r.state, r.state_info) for r in out.collect()}


def test_rule_list_shape(spark):
    rules = default_rules(spark)
    assert rules.count() == 21
    assert rules.where("type = 'soft'").count() == 17 and rules.where("type = 'hard'").count() == 4
    order = rule_order(rules)
    assert [r["type"] for r in order] == ["soft"] * 17 + ["hard"] * 4
    assert [r["rule_id"] for r in order] == list(range(1, 18)) + list(range(18, 22))
    defaults = {r.rule_id: r.default_order for r in rules.collect()}
    assert defaults[1] == 21 and defaults[21] == 1
    first = rules.where("rule_id = 1").first()
    assert first.regex.startswith("((try.*later)|(connection.*lost)|")


def test_documented_classifications(spark):
    got = _classify(spark, [
        (1, "deferred", "network connection timed out", False),
        (2, "bounced", "this email was blacklisted", False),
        (3, "sent", "250 ok", False),
        (4, "sent", "250 ok", True),
        (5, "expired", "returned to sender", True),
        (6, "bounced", "something nobody has a rule for", False),
        (7, "deferred", "Host or domain name not found. Name service error for name=x type=MX: Host not found", False),
    ])
    assert got[1] == (0, "bad domain: connection timeout")
    assert got[2] == (1, "spam detection and blacklisting")
    assert got[3] == (3, "OK")
    assert got[4] == (4, "finally OK")
    assert got[5] == (0, "expired, returned to sender")
    assert got[6] == (2, "unable to decide on type of bounce")
    # matches both "host not found" and "dns problem": document order wins
    assert got[7] == (0, "bad domain: host/domain not found")


def test_soft_beats_hard_and_hits_reorder(spark):
    rules = default_rules(spark)
    text = "550 user unknown, try again later"  # hard 550 and soft "try again"
    assert _classify(spark, [(1, "bounced", text, False)], rules)[1] == (0, "try again")
    dns = "host not found. name service error"
    hits = spark.createDataFrame([(14, 100)], "rule_id int, hits long")  # dns problem
    assert _classify(spark, [(1, "deferred", dns, False)], rules, hits)[1] == (0, "dns problem")


def test_rule_hits_and_reclassify(spark):
    rules = default_rules(spark)
    df = spark.createDataFrame([(1, "bounced", "blacklisted", False), (2, "bounced", "blacklist", False),
                                (3, "sent", "ok", False)],
                               "i int, status string, info string, has_been_deferred boolean")
    hits = {r.rule_id: r.hits for r in bounce_rule_hits(classify(df, rules, keep_rule_id=True), rules).collect()}
    assert len(hits) == 21 and hits[19] == 2 and sum(hits.values()) == 2
    stored = classify(df, rules).drop("has_been_deferred")
    again = {r.i: (r.state, r.state_info) for r in reclassify(stored, rules).collect()}
    assert again == {1: (1, "spam detection and blacklisting"), 2: (1, "spam detection and blacklisting"),
                     3: (3, "OK")}


def test_xml_round_trip_and_validation(spark, scratch):
    path = os.path.join(scratch, "rules.xml")
    write_rules_xml(path)
    loaded = load_bounce_rules(spark, path)
    a = [(r.rule_id, r.type, r.category, r.default_order, list(r.patterns), r.regex) for r in loaded.collect()]
    b = [(r.rule_id, r.type, r.category, r.default_order, list(r.patterns), r.regex)
         for r in default_rules(spark).collect()]
    assert sorted(a) == sorted(b)
    assert validate_bounce_rules(spark, path).count() == 0

    bad = os.path.join(scratch, "bad.xml")
    write_rules_xml(bad, [("soft", "ok", ["a.*b"]), ("hard", "broken", ["(unclosed"])])
    with pytest.raises(InvalidRuleList):
        load_bounce_rules(spark, bad)
    empty = os.path.join(scratch, "empty.xml")
    write_rules_xml(empty, [("soft", "x", [""])])
    assert validate_bounce_rules(spark, empty).count() == 1
    with open(os.path.join(scratch, "nocat.xml"), "w") as fh:
        fh.write('<bounces><regex type="soft"><or>a</or></regex><other/></bounces>')
    reasons = {r.reason for r in validate_bounce_rules(spark, os.path.join(scratch, "nocat.xml")).collect()}
    assert "missing category" in reasons and any("children" in r for r in reasons)


def test_default_rules_module_is_document_order():
    assert DEFAULT_RULES[0][1] == "try again" and DEFAULT_RULES[-1][1] == "authentication required"


def test_categories_with_quotes_survive(spark):
    from relaylens.sources.rules import rules_from_list

    rules = rules_from_list(spark, [("hard", "isn't \\\\ here", ["nope"]), ("soft", "it's 'quoted'", ["later"])])
    got = _classify(spark, [(1, "deferred", "try later", False), (2, "bounced", "nope", False)], rules)
    assert got == {1: (0, "it's 'quoted'"), 2: (1, "isn't \\\\ here")}


def test_rule_regex_with_escapes(spark):
    from relaylens.sources.rules import rules_from_list

    rules = rules_from_list(spark, [("soft", "three digits", [r"\d{3} blocked"]), ("hard", "dot", [r"a\.b"])])
    got = _classify(spark, [(1, "deferred", "421 blocked", False), (2, "bounced", "axb", False),
                            (3, "bounced", "a.b", False)], rules)
    assert got == {1: (0, "three digits"), 2: (2, "unable to decide on type of bounce"), 3: (1, "dot")}
