import gzip
import os

from relaylens.sources import logfiles as LF


def _write(path, data: bytes):
    with open(path, "wb") as fh:
        fh.write(data)


def test_budget_selection(spark, scratch):
    # live file 10 bytes; rotated files 10..54 bytes; budget 0.000065 MB
    _write(os.path.join(scratch, "mail.log"), b"x" * 10)
    for i, n in enumerate([10, 21, 32, 43, 54], start=1):
        _write(os.path.join(scratch, f"mail.log.{i}"), b"y" * n)
    _write(os.path.join(scratch, "other.txt"), b"z" * 99)
    files = LF.list_log_files(spark, scratch)
    assert files.count() == 6
    sel = {r.file: r.selected for r in LF.select_log_files(files, budget_mb=0.000065).collect()}
    assert sel == {"mail.log.1": True, "mail.log.2": True, "mail.log.3": False, "mail.log.4": False,
                   "mail.log.5": False}


def test_budget_rules(spark):
    files = spark.createDataFrame(
        [("mail.log.1", 1, 5), ("mail.log.2.gz", 2, 50), ("mail.log.3", 3, 100), ("mail.log.12", 12, 200),
         ("mail.log.13", 13, 10)],
        "file string, rotation int, size_bytes long")
    sel = {r.file: r.selected for r in LF.select_log_files(files, budget_mb=700 / 1024 / 1024,
                                                           live_size_bytes=0).collect()}
    # .1 is under 10 bytes; .2.gz counts 500; .3 brings the total to 600; .12 overflows,
    # and after the first overflow even a small older file stays out (12 before 13, numerically)
    assert sel == {"mail.log.1": False, "mail.log.2.gz": True, "mail.log.3": True, "mail.log.12": False,
                   "mail.log.13": False}


def test_read_order_gzip_and_digests(spark, scratch):
    _write(os.path.join(scratch, "mail.log.2.gz"), gzip.compress(b"old first\nold second\n"))
    _write(os.path.join(scratch, "mail.log.1"), b"new first\r\nnew second\n")
    files = LF.list_log_files(spark, scratch)
    raw = LF.read_mail_logs(spark, [r.path for r in files.collect()])
    rows = raw.orderBy(raw.rotation.desc(), "file", "block_start", "line_seq").collect()
    assert [r.line for r in rows] == ["old first", "old second", "new first", "new second"]
    assert {r.rotation for r in rows} == {1, 2}
    d1 = {r.file: r.digest for r in LF.file_digests(files).collect()}
    d2 = {r.file: r.digest for r in LF.digests_from_lines(raw).collect()}
    assert d1 == d2
    import hashlib
    assert d1["mail.log.1"] == hashlib.md5(b"new first").hexdigest()


def test_skip_and_list_ingested(spark, scratch):
    _write(os.path.join(scratch, "mail.log.1"), b"line one of a\nmore\n")
    _write(os.path.join(scratch, "mail.log.2"), b"line one of b\nmore\n")
    files = LF.list_log_files(spark, scratch)
    dig = LF.file_digests(files).join(files.select("path", "size_bytes"), "path")
    # the ledger is a stored table, not a view over the directory
    ledger = spark.createDataFrame(dig.where("file = 'mail.log.2'").select("file", "digest").collect())
    assert [r.file for r in LF.skip_ingested(dig, ledger).collect()] == ["mail.log.1"]
    assert [r.file for r in LF.ingested_log_files(dig, ledger).collect()] == ["mail.log.2"]
    # rotation renames the file: the same first line keeps it skipped
    os.rename(os.path.join(scratch, "mail.log.2"), os.path.join(scratch, "mail.log.3"))
    files = LF.list_log_files(spark, scratch)
    dig = LF.file_digests(files)
    assert [r.file for r in LF.skip_ingested(dig, ledger).collect()] == ["mail.log.1"]


def _fold_budget(files, budget_bytes):
    """Sequential walk newest -> oldest, as the original file arbiter does."""
    remaining, picked = budget_bytes, set()
    for name, rot, size in sorted(files, key=lambda f: (f[1], f[0])):
        if size < 10 or remaining < 0:
            continue
        weighted = size * 10 if name.endswith("gz") or name.endswith("tar") else size
        remaining -= weighted
        if remaining > 0:
            picked.add(name)
    return picked


def test_budget_matches_sequential_walk(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 120), st.integers(0, 400), st.booleans()),
                    min_size=1, max_size=8, unique_by=lambda t: t[0]),
           st.integers(0, 2500), st.integers(0, 300))
    def check(spec, budget, live):
        files = [(f"mail.log.{r}" + (".gz" if gz else ""), r, size) for r, size, gz in spec]
        df = spark.createDataFrame(files, "file string, rotation int, size_bytes long")
        got = {r.file for r in LF.select_log_files(df, budget / 1024 / 1024, live_size_bytes=live).collect()
               if r.selected}
        assert got == _fold_budget(files, budget - live)

    check()
