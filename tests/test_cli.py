import json
import os

from relaylens.__main__ import main
from tests import fixture_log


def test_cli_index_query_status(spark, scratch, capsys):
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    with open(os.path.join(logs, "mail.log.1"), "w") as fh:
        fh.write("\n".join(fixture_log.lines()) + "\n")
    assert main(["index", "--log-dir", logs, "--index-dir", index]) == 0
    assert json.loads(capsys.readouterr().out.strip()) == {"indexed_files": ["mail.log.1"]}

    main(["query", "--index-dir", index, "--client", fixture_log.CLIENT, "--group-by", "msgId", "--last"])
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and {r["group_key"] for r in rows} == {
        "98494.7002.22", "98494.7003.33", "msgId-web-55"}

    main(["query", "--index-dir", index, "--client", fixture_log.CLIENT, "--from-ms", "1551657600000",
          "--to-ms", "1552348800000", "--slice-ms", "86400000", "--group-by", "msgId"])
    slices = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted({r["slice_id"] for r in slices}) == list(range(8))

    main(["status", "--index-dir", index, "ingest-stats"])
    stats = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["file"], r["attempts"]) for r in stats] == [("mail.log.1", 11)]

    out = os.path.join(scratch, "ids")
    main(["status", "--index-dir", index, "client-ids", "--out", out])
    assert [json.loads(r.value)["client_id"] for r in spark.read.text(out).collect()] == [fixture_log.CLIENT]

    main(["status", "--index-dir", index, "open-queues"])
    assert [json.loads(x)["queue_id"] for x in capsys.readouterr().out.splitlines()] == [fixture_log.Q_LATE]
    landing = os.path.join(scratch, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "chunk-1"), "w") as fh:
        fh.write(f"2019 Mar 11 00:31:00.010 h postfix/qmgr[1]: {fixture_log.Q_LATE}: removed\n")
    assert main(["stream", "--landing-dir", landing, "--index-dir", index, "--once"]) == 0
    main(["status", "--index-dir", index, "open-queues"])
    assert capsys.readouterr().out == ""
    from relaylens.sources.default_rules import DEFAULT_RULES
    from relaylens.sources.rules import write_rules_xml

    write_rules_xml(os.path.join(scratch, "rules.xml"), [("soft", "other words", ["blacklisted"]), *DEFAULT_RULES])
    assert main(["reclassify", "--index-dir", index, "--rules", os.path.join(scratch, "rules.xml"), "--out", os.path.join(scratch, "again")]) == 0
    from relaylens.plans.sink import read_deliveries

    again = read_deliveries(spark, os.path.join(scratch, "again"))
    assert again.count() == 11 and again.where("state_info = 'other words'").count() == 1
