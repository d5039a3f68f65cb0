"""Mail-log files (SRC-1..6): listing, size budget, first-line digests, reading.

* listing uses the ``binaryFile`` source without its ``content`` column, so
  only file metadata is read;
* the first line of each file (its digest) and its last bytes are read inside tasks with Arrow's
  file system layer -- two short reads per file, distributed over executors; for schemes that only Hadoop
  knows the driver makes them through Hadoop's;
* a first line alone never decides that a file is left out: see ``prefixes``;
* lines are read with the text source (gzip by suffix, one task per ``.gz``;
  plain files split).  Line order within a file is
  ``(_metadata.file_block_start, monotonically_increasing_id())``: a split is
  read by one task in order, and a file's splits are ordered by their start.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import patterns as P

BLOCK_LINES = 200_000

def _name(col: str = "path"):
    return F.regexp_extract(F.col(col), r"([^/]+)$", 1)


def list_log_files(spark: SparkSession, log_dir: str, pattern: str = P.ROTATED_FILE_PATTERN,
                   live_file: str = P.LIVE_FILE_NAME) -> DataFrame:
    """Files of ``log_dir``: (path, file, size_bytes, rotation, is_live, modified).

    Rotated files are those whose *whole* name matches ``pattern``; group 1 is
    the rotation number.  The live file gets rotation 0 (newest)."""
    listing = (spark.read.format("binaryFile").load(log_dir)
               .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")))
    full = f"^(?:{pattern})$"
    named = listing.withColumn("file", _name())
    rotated = F.col("file").rlike(full)
    return named.where(rotated | (F.col("file") == live_file)).select(
        "path", "file", "size_bytes",
        F.when(rotated, F.regexp_extract("file", full, 1).cast("int")).otherwise(F.lit(0)).alias("rotation"),
        (F.col("file") == live_file).alias("is_live"), "modified",
    )


def weighted_size(file_col="file", size_col="size_bytes"):
    name = F.col(file_col)
    factor = F.when(name.endswith("gz") | name.endswith("tar"), F.lit(P.COMPRESSED_SIZE_FACTOR)).otherwise(F.lit(1))
    return F.col(size_col) * factor


def select_log_files(files: DataFrame, budget_mb: float | None = None,
                     live_size_bytes: int | None = None) -> DataFrame:
    """SRC-4: which rotated files fit the size budget; all of them without one.

    Walk newest to oldest (rotation ascending); files under 10 bytes are
    skipped; compressed files count ten times; a file is taken while the
    remaining budget stays positive, and after the first overflow every older
    file is left out.  ``live_size_bytes`` defaults to the listed live file.

    The window runs over the file listing (one row per file of one log
    directory), never over log lines."""
    has_live = "is_live" in files.columns
    is_live = F.col("is_live") if has_live else F.lit(False)
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if live_size_bytes is None:
        live_size = F.sum(F.when(is_live, F.col("size_bytes")).otherwise(F.lit(0))).over(everything)
    else:
        live_size = F.lit(int(live_size_bytes))
    if budget_mb is None:
        return files.where(~is_live).select(*files.columns, (F.col("size_bytes") >= P.MIN_FILE_BYTES).alias("selected"))
    budget = F.lit(float(budget_mb) * 1024 * 1024) - live_size
    counted = F.when(~is_live & (F.col("size_bytes") >= P.MIN_FILE_BYTES), weighted_size()).otherwise(F.lit(0))
    w = Window.partitionBy(F.lit(1)).orderBy("rotation", "file").rowsBetween(Window.unboundedPreceding, 0)
    out = files.withColumn("_cum", F.sum(counted).over(w)).withColumn("_budget", budget).where(~is_live)
    selected = (F.col("size_bytes") >= P.MIN_FILE_BYTES) & ((F.col("_budget") - F.col("_cum")) > 0)
    return out.select(*files.columns, selected.alias("selected"))


TAIL_BYTES = 65_536
_ARROW_SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")


def _first_line(read, size: int, gz: bool) -> str | None:
    """The first line of a file of which ``read(offset, n)`` reads a part; None if the file holds nothing."""
    unzip = zlib.decompressobj(31) if gz else None
    buf, at = b"", 0
    while at < size:
        chunk = read(at, min(8192, size - at))
        at += len(chunk)
        buf += unzip.decompress(chunk) if gz else chunk
        cut = [i for i in (buf.find(b"\n"), buf.find(b"\r")) if i >= 0]
        if cut:
            return buf[:min(cut)].decode("utf-8", errors="replace")
        if not chunk:
            break
    return buf.decode("utf-8", errors="replace") if buf else None


def _head(path: str, read, size: int) -> tuple[str | None, str, bool]:
    line = _first_line(read, size, path.endswith(".gz"))
    tail = read(max(0, size - TAIL_BYTES), min(size, TAIL_BYTES)) if size else b""
    ended = path.endswith(".gz") or tail[-1:] in (b"\n", b"\r", b"")
    return (None if line is None else hashlib.md5(line.encode("utf-8")).hexdigest()), hashlib.md5(tail).hexdigest(), ended


def _arrow_head(path: str) -> tuple[str | None, str, bool]:
    import pyarrow.fs as pafs

    u = urlparse(path)
    fs, inner = (pafs.LocalFileSystem(), unquote(u.path)) if u.scheme in ("", "file") else pafs.FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        def read(offset, n):
            f.seek(offset)
            return f.read(n)

        return _head(path, read, f.size())


def file_digests(files: DataFrame) -> DataFrame:
    """SRC-5: (path, file, digest, tail, ended): md5 of each file's first line, of its last bytes; whether its last line has ended.

    Runs in tasks (``mapInPandas``).  An empty file has no digest; a blank first line has that of ''."""
    spark = files.sparkSession
    schema = "path string, file string, digest string, tail string, ended boolean"
    # the files of one directory
    one = files.select(F.regexp_extract("path", r"^([a-zA-Z0-9+.-]+):", 1).alias("s")).first()
    if one and (one.s or "") not in _ARROW_SCHEMES:
        # one row per file, never data
        rows = [(r.path, r.file, *_head(r.path, lambda o, n, p=r.path: storage.read_bytes(spark, p, o, n), r.size_bytes))
                for r in files.select("path", "file", "size_bytes").collect()]
        return spark.createDataFrame(rows, schema)

    def heads(batches):
        for pdf in batches:
            got = [_arrow_head(p) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "file": pdf["file"], "digest": [g[0] for g in got], "tail": [g[1] for g in got], "ended": [g[2] for g in got]})
    return files.select("path", "file").mapInPandas(heads, schema)


def numbered_lines(raw_lines: DataFrame) -> DataFrame:
    """``raw_lines`` with ``line_no``, the line's number in its file from 0.

    Numbers run on inside a block (one task reads it); blocks are counted, and their first numbers come from a
    running sum over a file's blocks -- rows per file and block, never lines."""
    blocks = raw_lines.groupBy("file", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("line_seq").alias("first_seq"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block_start", "first_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_no"))
    return raw_lines.join(blocks, ["file", "block_start"]).withColumn(
        "line_no", F.col("first_no") + F.col("line_seq") - F.col("first_seq")).drop("first_no", "first_seq")


def digests_from_lines(raw_lines: DataFrame) -> DataFrame:
    """SRC-5 over lines already read: md5 of the first line of each file.

    A partial aggregation (min by line position) per file."""
    first = raw_lines.groupBy("file").agg(
        F.min_by("line", F.struct("block_start", "line_seq")).alias("first_line"))
    return first.select("file", F.md5(F.col("first_line")).alias("digest"))


def skip_ingested(files_with_digest: DataFrame, ledger: DataFrame) -> DataFrame:
    """SRC-5: files whose digest is not in the ledger (renamed files stay skipped)."""
    return files_with_digest.join(ledger.select("digest").distinct(), "digest", "left_anti")


def ingested_log_files(files_with_digest: DataFrame, ledger: DataFrame) -> DataFrame:
    """SRC-6: present files (>= 10 bytes) already ingested, sorted by name."""
    present = files_with_digest
    if "size_bytes" in present.columns:
        present = present.where(F.col("size_bytes") >= P.MIN_FILE_BYTES)
    return present.join(ledger.select("digest").distinct(), "digest", "left_semi").orderBy("file")


def _placed(df: DataFrame, pattern: str, live_file: str) -> DataFrame:
    """Lines of the text source with their place, as ``raw_lines``."""
    full = f"^(?:{pattern})$"
    df = df.select(
        F.col("_metadata.file_name").alias("file"),
        # a split of many lines, such as a .gz, counts as several blocks: each is a bounded unit of the lifecycle scan
        (F.col("_metadata.file_block_start") + F.floor(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) / BLOCK_LINES)).alias("block_start"),
        F.monotonically_increasing_id().alias("line_seq"),
        F.col("value").alias("line"),
    )
    rotation = F.when(F.col("file").rlike(full), F.regexp_extract("file", full, 1).cast("int")) \
        .when(F.col("file") == live_file, F.lit(0))
    return df.select("file", rotation.alias("rotation"), "block_start", "line_seq", "line")


def read_mail_logs(spark: SparkSession, paths: list[str], pattern: str = P.ROTATED_FILE_PATTERN,
                   live_file: str = P.LIVE_FILE_NAME) -> DataFrame:
    """SRC-1..3: lines of the given files as ``raw_lines``.

    ``paths`` is the (short) list of selected files; decompression follows the
    suffix."""
    if not paths:
        from ..schema import RAW_LINES
        return spark.createDataFrame([], RAW_LINES)
    return _placed(spark.read.text(paths), pattern, live_file)


NAMED_FILES = 1000  # so many files to read are named in the filter, one by one


def read_listed_logs(log_dir: str, files: DataFrame, pattern: str = P.ROTATED_FILE_PATTERN,
                     live_file: str = P.LIVE_FILE_NAME) -> DataFrame:
    """SRC-1..3: lines of the files of ``log_dir`` that ``files`` (file, modified) lists, as ``raw_lines``.

    The directory is read as one table: filters on the files' names and times prune the files that are
    opened, a semi-join keeps those listed.  No list of files goes through the driver, but for up to ``NAMED_FILES`` names,
    which then prune exactly."""
    spark = files.sparkSession
    text = spark.read.text(log_dir)
    name = F.col("_metadata.file_name")
    names = [r.file for r in files.select("file").limit(NAMED_FILES + 1).collect()]
    if len(names) <= NAMED_FILES:
        return _placed(text.where(name.isin(names)), pattern, live_file)
    oldest = files.agg(F.min("modified")).head()[0]
    likely = name.rlike(f"^(?:{pattern})$") | (name == live_file)
    lines = _placed(text.where(likely & (F.col("_metadata.file_modification_time") >= F.lit(oldest))), pattern, live_file)
    return lines.join(files.select("file"), "file", "left_semi")
