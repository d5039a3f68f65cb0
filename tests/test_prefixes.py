"""Files taken in by parts: prefixes, live files cut inside a line, what is left out; the commit log and compaction."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from relaylens import storage
from relaylens.plans import commits, compact
from relaylens.plans.index_job import read_rule_hits, recipient_estimates, run_index, skipped_files
from relaylens.plans.sink import committed_runs, read_index, read_open_queues
from relaylens.sources import logfiles as LF
from relaylens.sources import prefixes
from tests import fixture_log
from tests.test_index_job import _logs, _message, _records, _write_lines


def _write(path, data: bytes, at=None):
    with open(path, "wb") as fh:
        fh.write(data)
    if at is not None:
        os.utime(path, (at, at))


def _numbered(spark, files):
    rows = [(f, 1, 0, i, x) for f, lines in files.items() for i, x in enumerate(lines)]
    raw = spark.createDataFrame(rows, "file string, rotation int, block_start long, line_seq long, line string")
    return LF.numbered_lines(prefixes.staged(raw))


def test_longest_known_prefix(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "RUN_LINES", 10)
    base = [f"line {i}" for i in range(57)]
    old = {"a": base[:34], "b": base[:20], "c": base[:7], "e": ["x"] * 3}
    new = {
        "same": base[:34], "grown": base, "shorter": base[:25], "changed": base[:13] + ["other"] + base[14:],
        "short": base[:5], "cut": base[:7] + ["else"], "none": ["z", *base[1:]], "moved": base[1:], "twice": ["x"] * 25,
    }

    def files(spec, ended=True):
        return spark.createDataFrame([(f, x[0], ended) for f, x in spec.items()], "file string, digest string, ended boolean")

    before = prefixes.prefixes(_numbered(spark, old), files(old))
    ledger = before.select("digest", "lines", "lo", "hi")
    lines = _numbered(spark, new)
    got = dict(prefixes.known_lines(lines, prefixes.prefixes(lines, files(new)), ledger).collect())
    assert got == {"same": 34, "grown": 34, "shorter": 20, "changed": 10, "cut": 7, "twice": 3}
    assert dict(prefixes.known_lines(lines, prefixes.prefixes(lines, files(new)), ledger.limit(0)).collect()) == {}
    # a last line that had not ended: the prefix without it is known, too
    open_ = prefixes.prefixes(_numbered(spark, {"f": base[:12]}), files({"f": base[:12]}, False))
    assert sorted(r.lines for r in open_.collect()) == [10, 11, 12]
    ledger = open_.select("digest", "lines", "lo", "hi")
    other = {"f": base[:11] + [base[11] + " ended", "more"]}
    lines = _numbered(spark, other)
    assert dict(prefixes.known_lines(lines, prefixes.prefixes(lines, files(other)), ledger).collect()) == {"f": 11}


def test_live_file_cut_inside_a_line(spark, scratch):
    """Neither hits nor deliveries come twice; the queue was opened in an earlier file."""
    logs, index = _logs(scratch, "logs", mail_log_1=_message("A" * 15)[:1]), os.path.join(scratch, "index")
    run_index(spark, logs, index)
    live = "\n".join([_message("A" * 15, status="deferred")[1], _message("A" * 15)[1], *_message("B" * 15)]) + "\n"
    for share in (0.3, 0.7, 1.0):
        _write(os.path.join(logs, "mail.log"), live[:int(len(live) * share)].encode())
        res = run_index(spark, logs, index, include_live=True)
    assert res.files == ["mail.log"] and res.counters["attempts"] == 1
    one = os.path.join(scratch, "one")
    run_index(spark, logs, one, include_live=True)
    assert _records(spark, index) == _records(spark, one) and len(_records(spark, one)) == 3
    assert sorted(read_rule_hits(spark, index).collect()) == sorted(read_rule_hits(spark, one).collect())
    assert any("not ended yet" in r.reason for r in skipped_files(spark, index).collect())


def test_held_line_is_taken_after_rotation(spark, scratch):
    logs, index = _logs(scratch, "logs"), os.path.join(scratch, "index")
    text = "\n".join(_message("A" * 15)).encode()  # no end of line: the writer died there
    _write(os.path.join(logs, "mail.log"), text, 1_600_000_000)
    assert run_index(spark, logs, index, include_live=True).counters["attempts"] == 0
    assert run_index(spark, logs, index, include_live=True).files == []
    os.rename(os.path.join(logs, "mail.log"), os.path.join(logs, "mail.log.1"))
    assert run_index(spark, logs, index, include_live=True).files == ["mail.log.1"]
    assert len(_records(spark, index)) == 1


def test_corrected_copy_is_read(spark, scratch):
    """Same first line, size and last 64 KB, another middle."""
    filler = [f"2019 Mar 5 10:00:00.000 h postfix/x[1]: filler {i:06d} " + "y" * 60 for i in range(1500)]
    logs, index = _logs(scratch, "logs"), os.path.join(scratch, "index")
    lines = ["first", *_message("A" * 15, status="bounced"), *filler]
    _write(os.path.join(logs, "mail.log.1"), ("\n".join(lines) + "\n").encode(), 1_600_000_000)
    run_index(spark, logs, index)
    lines[2] = lines[2].replace("a@b.cz", "b@b.cz")
    _write(os.path.join(logs, "mail.log.1"), ("\n".join(lines) + "\n").encode(), 1_600_000_001)
    assert run_index(spark, logs, index).files == ["mail.log.1"]
    assert sorted(r.rcpt_email for r in read_index(spark, index).collect()) == ["a@b.cz", "b@b.cz"]
    # nothing has changed: said so if something else is left out, too; compared whole if times aren't trusted
    _write(os.path.join(logs, "mail.log.2"), b"x")
    assert run_index(spark, logs, index).files == []
    last = max(r.run for r in skipped_files(spark, index).collect())
    assert {(r.file, r.reason) for r in skipped_files(spark, index).where(F.col("run") == last).collect()} == {
        ("mail.log.1", "unchanged since an earlier run"), ("mail.log.2", "under 10 bytes")}
    lines[2] = lines[2].replace("b@b.cz", "c@b.cz")
    _write(os.path.join(logs, "mail.log.1"), ("\n".join(lines) + "\n").encode(), 1_600_000_001)
    assert run_index(spark, logs, index).files == []
    assert run_index(spark, logs, index, trust_times=False).files == ["mail.log.1"]


def test_left_out_files_are_listed_without_anything_to_read(spark, scratch):
    logs, index = _logs(scratch, "logs", mail_log_1=["y" * 3000]), os.path.join(scratch, "index")
    assert run_index(spark, logs, index, budget_mb=0.001).files == []
    assert [(r.file, r.reason) for r in skipped_files(spark, index).collect()] == [("mail.log.1", "over the size budget")]


def test_many_files_are_pruned_by_name_and_time(spark, scratch, monkeypatch):
    for i in range(1, 7):
        _write(os.path.join(scratch, f"mail.log.{i}" + (".gz" if i == 4 else "")), gzip.compress(b"d\n") if i == 4 else f"l{i}\nm\n".encode(), 1_600_000_000 - i)
    _write(os.path.join(scratch, "other.txt"), b"no log\n")
    files = LF.list_log_files(spark, scratch).where("rotation IN (2, 4)")
    want = [("mail.log.2", 2, "l2"), ("mail.log.2", 2, "m"), ("mail.log.4.gz", 4, "d")]
    for named in (1000, 1):
        monkeypatch.setattr(LF, "NAMED_FILES", named)
        got = LF.read_listed_logs(scratch, files)
        assert sorted((r.file, r.rotation, r.line) for r in got.collect()) == want


# ---- commit log

def test_log_of_commits(spark, scratch, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 4)
    for i in range(11):
        log = commits.read_log(spark, scratch)
        commits.commit(spark, scratch, log, 100 + i, state="snapshot" if i % 5 == 0 else "changes", watermark=[7, None, 9][i % 3])
    log = commits.read_log(spark, scratch)
    assert (log.last, log.live, log.state, log.watermark) == (10, list(range(100, 111)), [110], 9)
    assert len([n for n in os.listdir(f"{scratch}/commits") if n.endswith(".json") and n[0] != "."]) <= 2 * 4
    commits.commit(spark, scratch, log, 900, drops=[100, 101, 102, 105])
    again = commits.read_log(spark, scratch)
    assert again.live == [103, 104, *range(106, 111), 900] and again.replaced == [[100, 102], [105, 105]] and again.state == [110]
    assert again.knows(101) and again.knows(110) and not again.knows(111)


def test_commits_side_by_side(spark, scratch):
    for run in (1, 2):
        commits.commit(spark, scratch, commits.read_log(spark, scratch), run, state="changes")
    before_run, before_merge = commits.read_log(spark, scratch), commits.read_log(spark, scratch)
    commits.commit(spark, scratch, before_merge, 10, drops=[1, 2])
    commits.commit(spark, scratch, before_run, 3, state="changes")  # a compaction came first: fine
    assert commits.read_log(spark, scratch).live == [10, 3]
    one, two = commits.read_log(spark, scratch), commits.read_log(spark, scratch)
    commits.commit(spark, scratch, one, 4, state="changes")
    with pytest.raises(FileExistsError):  # another run came first
        commits.commit(spark, scratch, two, 5, state="changes")
    merge = commits.read_log(spark, scratch)
    commits.commit(spark, scratch, commits.read_log(spark, scratch), 6, state="changes")
    commits.commit(spark, scratch, merge, 11, drops=[10, 3])
    assert commits.read_log(spark, scratch).live == [4, 6, 11]


# ---- compaction

def test_tiers():
    sizes = {i: 10 for i in range(9)} | {20: 500, 21: 900} | {30: 70_000}
    assert compact.tiers(sizes, fan=8, small=100) == [list(range(9))]
    assert compact.tiers({i: 10 for i in range(7)}, fan=8, small=100) == []
    assert compact.tiers(sizes, fan=2, small=100) == [list(range(9))]  # 500 and 900 are two tiers of a factor of 2 apart


def _three_runs(spark, scratch):
    lines = fixture_log.lines()
    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs, exist_ok=True)
    for k, (a, b) in enumerate([(0, 12), (12, 19), (19, len(lines))]):
        _write_lines(os.path.join(logs, f"mail.log.{50 - k}"), lines[a:b])
        run_index(spark, logs, index)
    return logs, index


def _answers(spark, index):
    return (_records(spark, index), sorted(read_rule_hits(spark, index).collect()), sorted(recipient_estimates(spark, index).collect()),
            sorted(tuple(r) for r in read_open_queues(spark, f"{index}/open_queues").collect()),
            sorted((r.file, r.reason) for r in skipped_files(spark, index).collect()))


def test_compaction_changes_no_answer(spark, scratch, monkeypatch):
    logs, index = _three_runs(spark, scratch)
    before = _answers(spark, index)
    assert len(before[0]) == 11 and len(committed_runs(spark, index)) == 3
    # a crash while the merged folders are written, before the commit
    with monkeypatch.context() as m:
        m.setattr(compact, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            compact.compact_index(spark, index, fan=3)
    assert _answers(spark, index) == before and len(committed_runs(spark, index)) == 3
    done = compact.compact_index(spark, index, fan=3)
    assert committed_runs(spark, index) == done and _answers(spark, index) == before
    # replaced folders are still there; a crash between two deletions leaves an answer, too
    assert len(storage.runs(spark, f"{index}/deliveries")) > 2
    delete, seen = storage.delete, []
    with monkeypatch.context() as m:
        def some(s, path):
            if len(seen) == 3:
                raise RuntimeError("lost")
            seen.append(path)
            delete(s, path)

        m.setattr(storage, "delete", some)
        with pytest.raises(RuntimeError, match="lost"):
            compact.vacuum(spark, index)
    assert _answers(spark, index) == before
    compact.vacuum(spark, index)
    assert _answers(spark, index) == before
    assert set(done) <= set(storage.runs(spark, f"{index}/deliveries"))
    # files are still known, the open queue goes on, and the next run is like any other
    assert run_index(spark, logs, index).files == []
    _write_lines(os.path.join(logs, "mail.log.9"), [x.replace("Mar 11 00:30", "Mar 11 00:40") for x in fixture_log.lines()[-1:]])
    assert run_index(spark, logs, index).files == ["mail.log.9"]
    assert len(_records(spark, index)) == 12


def test_open_queues_as_changes(spark, scratch, monkeypatch):
    """Runs write what they touch; every so many write a snapshot."""
    from relaylens.plans import index_job

    logs, index = os.path.join(scratch, "logs"), os.path.join(scratch, "index")
    os.makedirs(logs)
    many = [x for i in range(40) for x in _message(f"Q{i:014d}")[:1]]
    _write_lines(os.path.join(logs, "mail.log.90"), many)
    run_index(spark, logs, index)
    removed = "2019 Mar 5 11:00:00.000 h postfix/qmgr[1]: {}: removed"
    _write_lines(os.path.join(logs, "mail.log.89"), [removed.format(f"Q{3:014d}"), _message(f"Q{4:014d}", status="deferred")[1], *_message("N" * 15)[:1]])
    res = run_index(spark, logs, index)
    written = spark.read.parquet(f"{index}/open_queues/run={res.run}")
    assert sorted((r.queue_id[-3:], r.closed, r.has_been_deferred) for r in written.collect()) == [("003", True, None), ("004", False, True), ("NNN", False, False)]
    state = {r.queue_id: r.has_been_deferred for r in read_open_queues(spark, f"{index}/open_queues").collect()}
    assert len(state) == 40 and f"Q{3:014d}" not in state and state[f"Q{4:014d}"] is True
    # after FOLD runs the sum is written whole, without closed queues
    monkeypatch.setattr(index_job, "FOLD", 2)
    _write_lines(os.path.join(logs, "mail.log.88"), [removed.format(f"Q{5:014d}")])
    res = run_index(spark, logs, index)
    assert commits.read_log(spark, index).state == [res.run]
    assert len(set(r.queue_id for r in read_open_queues(spark, f"{index}/open_queues").collect())) == 39
    assert spark.read.parquet(f"{index}/open_queues/run={res.run}").count() == 39


def test_estimates_within_the_sketch_s_error(spark):
    from relaylens.operators.status import estimated_recipients, merged_sketches, recipient_sketches

    df = spark.range(60_000).selectExpr("concat('c', id % 2) AS client_id", "date_add(date'2024-01-01', cast(id % 5 AS int)) AS day",
                                        "concat('r', id % 20000) AS rcpt_email")
    df = df.unionByName(spark.sql("SELECT 'none' AS client_id, date'2024-01-02' AS day, cast(null AS string) AS rcpt_email"))
    parts = [recipient_sketches(df.where(f"day {c} date'2024-01-03'")) for c in ("<", ">=")]
    every = merged_sketches(parts[0].unionByName(parts[1]))
    got = dict(estimated_recipients(every).collect())
    assert got["none"] == 0 and all(abs(got[c] - 10_000) < 10_000 * 4 * 1.04 / 64 for c in ("c0", "c1"))
    days = dict(estimated_recipients(every, "2024-01-01", "2024-01-01").collect())
    assert set(days) == {"c0", "c1"} and all(abs(n - 2000) < 2000 * 4 * 1.04 / 64 for n in days.values())


# ---- look-ups

def test_bloom_filters_are_written(spark, scratch):
    logs, index = _logs(scratch, "logs", mail_log_1=fixture_log.lines()), os.path.join(scratch, "index")
    run_index(spark, logs, index)
    path = next(os.path.join(d, f) for d, _, files in os.walk(f"{index}/deliveries") for f in files if f.endswith(".parquet"))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        have = {columns.get(i).getPath().toDotString() for i in range(columns.size()) if columns.get(i).getBloomFilterOffset() > 0}
    finally:
        reader.close()
    assert {"rcpt_email", "queue_id", "msg_id"} <= have | _dictionary_only(columns)


def _dictionary_only(columns):
    """Columns whose values are all in a dictionary: Parquet looks there and writes no filter."""
    return {columns.get(i).getPath().toDotString() for i in range(columns.size()) if columns.get(i).hasDictionaryPage()}


# ---- expiry by log time

def _expiry_lines():
    def at(day, hour, queue, what):
        return f"2019 Mar {day} {hour:02d}:00:00.000 h postfix/x[1]: {queue}: {what}"

    attempt = "to=<a@b.cz>, relay=none, status=deferred (odd)"
    q, r, s = "Q" * 15, "R" * 15, "S" * 15
    return [
        at(1, 0, q, "message-id=<98494.1.1@c>"), at(1, 1, q, attempt), at(1, 2, r, "message-id=<98494.2.1@c>"),
        at(1, 9, q, attempt),  # 8 hours after its last line
        at(1, 9, r, attempt),  # 7 hours
        at(1, 8, s, "message-id=<98494.3.1@c>"),  # dates go back: the log time stays at 9
        at(1, 16, s, attempt), at(1, 23, s, attempt), at(2, 6, s, attempt),
        at(2, 7, r, attempt),  # expired
        at(2, 7, r, "message-id=<98494.4.1@c>"), at(2, 8, r, attempt), at(2, 8, q, "removed"),
    ]


def _sequential(lines, ttl_hours):
    """Queue and hour of the attempts that count, by a walk through the lines."""
    import datetime as dt

    now, entry, out = None, {}, []
    for x in lines:
        t = dt.datetime.strptime(" ".join(x.split(" ")[:4]), "%Y %b %d %H:%M:%S.%f")
        now = t if now is None else max(now, t)
        queue, what = x.split("]: ")[1].split(": ", 1)
        if queue in entry and now - entry[queue] > dt.timedelta(hours=ttl_hours):
            del entry[queue]
        if what.startswith("message-id"):
            entry[queue] = t
        elif queue in entry:
            if what.startswith("to="):
                out.append((queue, int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)))
            entry[queue] = t
            if what == "removed":
                del entry[queue]
    return sorted(out)


@pytest.mark.parametrize("ttl_hours", [7])
def test_expiry_is_the_same_however_the_lines_come(spark, scratch, ttl_hours):
    lines, got = _expiry_lines(), []
    for name, cuts in (("one", [0, 13]), ("parts", [0, 3, 6, 9, 13])):
        logs, index = os.path.join(scratch, f"{name}-logs"), os.path.join(scratch, name)
        os.makedirs(logs)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            _write_lines(os.path.join(logs, f"mail.log.{90 - k}"), lines[a:b])
            run_index(spark, logs, index, ttl_ms=ttl_hours * 3_600_000)
        got.append(sorted((r.queue_id, r.date_ms) for r in read_index(spark, index).collect()))
    assert got[0] == got[1] == _sequential(lines, ttl_hours)


def test_expiry_inside_and_between_splits(spark):
    from relaylens.operators.lifecycle import correlate, with_log_time
    from relaylens.operators.parse import recognised_lines, usable

    lines = _expiry_lines()
    for every in (1, 2, 5, 100):
        raw = spark.createDataFrame([("f", 1, i // every, i, x) for i, x in enumerate(lines)],
                                    "file string, rotation int, block_start long, line_seq long, line string")
        rows = with_log_time(usable(recognised_lines(raw, log_dates=True)))
        for hours in (1, 7, 8):
            got = correlate(rows, ttl_ms=hours * 3_600_000).records
            assert sorted((r.queue_id, r.date_ms) for r in got.collect()) == _sequential(lines, hours)
