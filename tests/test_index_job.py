import os

import pytest

from relaylens.plans import index_job
from relaylens.plans.index_job import DIAGNOSTICS, REJECTED, STATS, read_ledger, read_rule_hits, run_index, skipped_files
from relaylens.plans.sink import (committed_runs, read_deliveries, read_index, read_open_queues, read_table, to_json_rows,
                                  write_deliveries)
from tests import fixture_log


def _write_lines(path, lines):
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def _records(spark, index_dir):
    d = read_index(spark, index_dir)
    cols = ["client_id", "date_ms", "queue_id", "msg_id", "rcpt_email", "sender_email", "status", "info",
            "state", "state_info"]
    return sorted(tuple(r) for r in d.select(*cols).collect())


def test_index_run_is_idempotent(spark, scratch):
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    _write_lines(os.path.join(logs, "mail.log"), ["live line"])
    _write_lines(os.path.join(logs, "mail.log.1"), fixture_log.lines())
    res = run_index(spark, logs, index)
    assert res.files == ["mail.log.1"]
    first = _records(spark, index)
    assert len(first) == 11
    assert [r.queue_id for r in read_open_queues(spark, f"{index}/open_queues").collect()] == [fixture_log.Q_LATE]
    assert read_ledger(spark, index).count() == 1
    st = read_table(spark, index, "ingest_stats", STATS).collect()
    assert [(r.file, r.message_id_lines, r.attempts, r.removed_lines) for r in st] == [("mail.log.1", 4, 11, 3)]
    assert read_table(spark, index, "diagnostics", DIAGNOSTICS).count() == 0
    again = run_index(spark, logs, index)
    assert again.files == [] and _records(spark, index) == first
    # partition layout: client and day folders
    assert os.path.isdir(os.path.join(index, "deliveries", f"run={res.run}", f"client_key=c-{fixture_log.CLIENT}"))
    js = to_json_rows(read_index(spark, index).select("client_id", "state")).first().json
    assert js.startswith('{"client_id":"billing-app"')


def test_rotation_and_continuation_equal_one_run(spark, scratch):
    lines = fixture_log.lines()
    cut = 12  # inside the third queue
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    _write_lines(os.path.join(logs, "mail.log"), ["x" * 20])
    _write_lines(os.path.join(logs, "mail.log.1"), lines[:cut])
    run_index(spark, logs, index)
    # logrotate: .1 -> .2, new .1 holds the rest
    os.rename(os.path.join(logs, "mail.log.1"), os.path.join(logs, "mail.log.2"))
    _write_lines(os.path.join(logs, "mail.log.1"), lines[cut:])
    res = run_index(spark, logs, index)
    assert res.files == ["mail.log.1"]
    got = _records(spark, index)

    one = os.path.join(scratch, "one")
    os.makedirs(os.path.join(one, "logs"))
    _write_lines(os.path.join(one, "logs", "mail.log.1"), lines)
    run_index(spark, os.path.join(one, "logs"), os.path.join(one, "index"))
    assert got == _records(spark, os.path.join(one, "index"))
    assert len(got) == 11


def test_gzip_budget_and_live_file(spark, scratch):
    import gzip

    lines = fixture_log.lines()
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    # oldest file is over budget and must be left out entirely
    _write_lines(os.path.join(logs, "mail.log.3"), ["2019 Mar 01 00:00:00.000 h postfix/x[1]: filler " + "y" * 400] * 50)
    with open(os.path.join(logs, "mail.log.2.gz"), "wb") as fh:
        fh.write(gzip.compress(("\n".join(lines[:12]) + "\n").encode()))
    _write_lines(os.path.join(logs, "mail.log.1"), lines[12:18])
    _write_lines(os.path.join(logs, "mail.log"), lines[18:])
    gz_size = os.path.getsize(os.path.join(logs, "mail.log.2.gz"))
    live = os.path.getsize(os.path.join(logs, "mail.log"))
    plain = os.path.getsize(os.path.join(logs, "mail.log.1"))
    budget_mb = (live + plain + 10 * gz_size + 100) / 1024 / 1024
    res = run_index(spark, logs, index, budget_mb=budget_mb, include_live=True)
    assert sorted(res.files) == ["mail.log", "mail.log.1", "mail.log.2.gz"]
    got = _records(spark, index)
    assert len(got) == 11


def test_adaptive_rule_order_uses_earlier_hits(spark, scratch):
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    line = ("2019 Mar 16 16:05:07.123 h postfix/smtp[1]: {q}: to=<a@b.cz>, relay=none, dsn=4.4.3, "
            "status=deferred (Host or domain name not found. Name service error for name=x type=MX)")

    def queue(q, text_line):
        return [f"2019 Mar 16 16:05:06.123 h postfix/cleanup[1]: {q}: message-id=<98494.1.2@cl>", text_line]

    # run 1: one text only "dns problem" matches, so that rule collects hits
    dns_only = "2019 Mar 16 16:05:07.123 h postfix/smtp[1]: {q}: to=<a@b.cz>, status=deferred (dns timeout)"
    _write_lines(os.path.join(logs, "mail.log.1"),
                 queue("AAAAAAAAAAAAAA1", dns_only.format(q="AAAAAAAAAAAAAA1"))
                 + queue("AAAAAAAAAAAAAA2", dns_only.format(q="AAAAAAAAAAAAAA2")))
    run_index(spark, logs, index, adaptive_rule_order=True)
    hits = {r.rule_id: r.hits for r in read_rule_hits(spark, index).collect()}
    assert hits[14] == 2
    # run 2: a text matching both "host not found" (earlier in the list) and "dns problem"
    os.rename(os.path.join(logs, "mail.log.1"), os.path.join(logs, "mail.log.2"))
    _write_lines(os.path.join(logs, "mail.log.1"), queue("BBBBBBBBBBBBBB1", line.format(q="BBBBBBBBBBBBBB1")))
    run_index(spark, logs, index, adaptive_rule_order=True)
    d = read_index(spark, index).where("queue_id = 'BBBBBBBBBBBBBB1'").first()
    assert d.state_info == "dns problem"


def test_same_file_under_two_names_is_read_once(spark, scratch):
    import gzip

    lines = fixture_log.lines()
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    _write_lines(os.path.join(logs, "mail.log.2"), lines)
    with open(os.path.join(logs, "mail.log.2.gz"), "wb") as fh:
        fh.write(gzip.compress(("\n".join(lines) + "\n").encode()))
    res = run_index(spark, logs, index)
    assert res.files == ["mail.log.2"]
    assert len(_records(spark, index)) == 11


def _logs(scratch, name, **files):
    folder = os.path.join(scratch, name)
    os.makedirs(folder, exist_ok=True)
    for k, lines in files.items():
        _write_lines(os.path.join(folder, k.replace("_", ".")), lines)
    return folder


def _message(queue, client="cl", day=5, rcpt="a@b.cz", status="bounced"):
    return [f"2019 Mar {day} 10:00:00.000 h postfix/cleanup[1]: {queue}: message-id=<98494.{queue}.1@{client}>",
            f"2019 Mar {day} 10:00:01.000 h postfix/smtp[1]: {queue}: to=<{rcpt}>, relay=none, status={status} (odd)"]


def test_files_that_share_their_first_line_are_all_read(spark, scratch):
    for first in ("same first line", ""):
        logs = _logs(scratch, f"logs{len(first)}", mail_log_1=[first, *_message("A" * 15)], mail_log_2=[first, *_message("B" * 15)])
        index = os.path.join(scratch, f"index{len(first)}")
        assert run_index(spark, logs, index).files == ["mail.log.1", "mail.log.2"]
        assert len(_records(spark, index)) == 2
        assert run_index(spark, logs, index).files == []
        # a later file with that first line is read, and said to be so
        os.rename(os.path.join(logs, "mail.log.2"), os.path.join(logs, "mail.log.3"))
        _write_lines(os.path.join(logs, "mail.log.2"), [first, *_message("C" * 15)])
        assert run_index(spark, logs, index).files == ["mail.log.2"]
        assert len(_records(spark, index)) == 3
        assert "shares only its first line" in skipped_files(spark, index).where("file = 'mail.log.2'").head().reason


def test_growing_live_file_goes_on_also_after_rotation(spark, scratch):
    a, b, c, d = (_message(x * 15) for x in "ABCD")
    logs = _logs(scratch, "logs", mail_log=a)
    index = os.path.join(scratch, "index")
    run_index(spark, logs, index, include_live=True)
    assert run_index(spark, logs, index, include_live=True).files == []
    _write_lines(os.path.join(logs, "mail.log"), a + b)
    assert run_index(spark, logs, index, include_live=True).files == ["mail.log"]
    _write_lines(os.path.join(logs, "mail.log.1"), a + b + c)
    _write_lines(os.path.join(logs, "mail.log"), d)
    assert run_index(spark, logs, index, include_live=True).files == ["mail.log", "mail.log.1"]
    assert len(_records(spark, index)) == 4
    # compressed after rotation: known by its lines
    import gzip

    os.remove(os.path.join(logs, "mail.log.1"))
    with gzip.open(os.path.join(logs, "mail.log.2.gz"), "wt") as fh:
        fh.write("\n".join(a + b + c) + "\n")
    assert run_index(spark, logs, index, include_live=True).files == []
    assert len(_records(spark, index)) == 4


def test_nothing_is_left_out_silently(spark, scratch):
    lines = _message("A" * 15) + ["2019 Brumaire 5 10:00:01.000 h postfix/smtp[1]: " + "A" * 15 + ": to=<a@b.cz>, status=deferred (x)"]
    logs = _logs(scratch, "logs", mail_log_1=lines, mail_log_2=["no mail line at all"], mail_log_3=["x"], mail_log_4=["y" * 3000])
    index = os.path.join(scratch, "index")
    res = run_index(spark, logs, index, budget_mb=0.001)
    assert res.files == ["mail.log.1", "mail.log.2"]
    assert {(r.file, r.reason) for r in skipped_files(spark, index).collect()} == {
        ("mail.log.3", "under 10 bytes"), ("mail.log.4", "over the size budget")}
    assert [r.reason for r in read_table(spark, index, "rejected_lines", REJECTED).collect()] == ["unparsable date"]
    assert {(r.file, r.attempts) for r in res.stats.collect()} == {("mail.log.1", 1), ("mail.log.2", 0)}
    assert run_index(spark, logs, index).files == ["mail.log.4"]


def test_clients_stay_apart(spark, scratch):
    logs = _logs(scratch, "logs", mail_log_1=[x for i, c in enumerate(("007", "7", "2024-01-01", "a/b=c%")) for x in _message(f"Q{i:014d}", c)] + [
        "2019 Mar 5 10:00:00.000 h postfix/cleanup[1]: " + "E" * 15 + ": message-id=m",
        "2019 Mar 5 10:00:00.000 h postfix/cleanup[1]: " + "E" * 15 + ": info: header client-id:  from x", _message("E" * 15)[1]])
    index = os.path.join(scratch, "index")
    run_index(spark, logs, index)
    got = read_index(spark, index)
    assert sorted(r.client_id for r in got.collect()) == ["", "007", "2024-01-01", "7", "a/b=c%"]
    write_deliveries(got, os.path.join(scratch, "copy"))
    write_deliveries(got, os.path.join(scratch, "copy"))
    copy = read_deliveries(spark, os.path.join(scratch, "copy"))
    assert copy.count() == 5 and copy.where("client_id = '7'").count() == 1 and copy.where("client_id = ''").count() == 1


@pytest.mark.parametrize("broken", ["write_deliveries", "write_open_queues", "ledger"])
def test_a_failed_run_counts_for_nothing(spark, scratch, monkeypatch, broken):
    lines = fixture_log.lines()
    logs, index, clean = _logs(scratch, "logs", mail_log_1=lines[:12]), os.path.join(scratch, "index"), os.path.join(scratch, "clean")
    for x in (index, clean):
        run_index(spark, logs, x)
    os.rename(os.path.join(logs, "mail.log.1"), os.path.join(logs, "mail.log.2"))
    _write_lines(os.path.join(logs, "mail.log.1"), lines[12:])

    with monkeypatch.context() as m:
        def fail(f):
            def run(*a, **k):
                f(*a, **k)  # what it writes is there
                raise RuntimeError("lost")
            return run

        if broken == "ledger":  # the ledger alone is missing
            write = index_job.write_table
            m.setattr(index_job, "write_table", lambda df, d, name, run: (_ for _ in ()).throw(RuntimeError("lost")) if name == "ingested_files" else write(df, d, name, run))
        else:
            m.setattr(index_job, broken, fail(getattr(index_job, broken)))
        with pytest.raises(RuntimeError, match="lost"):
            run_index(spark, logs, index)
    assert len(committed_runs(spark, index)) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("relaylens_rows_")]
    run_index(spark, logs, index)
    run_index(spark, logs, clean)
    assert _records(spark, index) == _records(spark, clean)
    for table, schema in (("diagnostics", DIAGNOSTICS), ("ingest_stats", STATS), ("rejected_lines", REJECTED)):
        a, b = (sorted(map(str, read_table(spark, x, table, schema).drop("run", "run_at").collect())) for x in (index, clean))
        assert a == b
    assert sorted(read_rule_hits(spark, index).collect()) == sorted(read_rule_hits(spark, clean).collect())
    ids = [sorted(r.queue_id for r in read_open_queues(spark, f"{x}/open_queues", committed_runs(spark, x)).collect()) for x in (index, clean)]
    assert ids[0] == ids[1] == [fixture_log.Q_LATE]


def test_last_valid_rules_stay_in_force(spark, scratch):
    from relaylens.sources.rules import write_rules_xml

    rules = os.path.join(scratch, "rules.xml")
    write_rules_xml(rules, [("soft", "strange", ["odd"])])
    logs, index = _logs(scratch, "logs", mail_log_2=_message("A" * 15)), os.path.join(scratch, "index")
    run_index(spark, logs, index, rules)
    with open(rules, "w") as fh:
        fh.write('<bounces><regex type="soft" category="x"><or>(</or></regex></bounces>')
    _write_lines(os.path.join(logs, "mail.log.1"), _message("B" * 15))
    run_index(spark, logs, index, rules)
    assert [r.state_info for r in read_index(spark, index).collect()] == ["strange", "strange"]
    assert "last valid one stays in force" in read_table(spark, index, "diagnostics", DIAGNOSTICS).head().reason
