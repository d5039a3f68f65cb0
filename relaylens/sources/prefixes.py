"""Prefix fingerprints of log files (SRC-5, SRC-9): how much of a file earlier runs have taken in.

A file is read once per run: ``staged`` keeps of each line its place and hash, and its text only if it may matter.
Lines are numbered; every ``RUN_LINES`` of them, and at the end of what is taken, the sums of
the lines' marks so far (a mark is a hash of number and text, as two halves) are the fingerprint of that prefix.
The ledger keeps these prefixes.  A file's longest prefix that the ledger knows says where to go on: whole runs of lines are
compared as rows, and inside the one run after them the sums are followed line by line to the ends of earlier
takes.  So a file that has grown goes on where it stopped, one that differs in its middle is read
from the last run of lines that both share, and copies under other names are known whatever their compression.

The last line of a live file without a line end may still be growing: it is held back until it has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.parse import may_matter

RUN_LINES = 4096
FILE_CHAINS = "digest string, lines long, lo long, hi long"
_HALF = (1 << 32) - 1


def staged(raw_lines: DataFrame) -> DataFrame:
    """``raw_lines`` with ``line_hash``, and ``line`` null where no kind of line can be recognised."""
    return raw_lines.select("file", "rotation", "block_start", "line_seq", F.xxhash64("line").alias("line_hash"),
                            F.when(may_matter(F.col("line")), F.col("line")).alias("line"))


def _marked(numbered: DataFrame) -> DataFrame:
    mark = F.xxhash64("line_no", "line_hash")
    return numbered.select("*", mark.bitwiseAND(F.lit(_HALF)).alias("lo"), F.shiftrightunsigned(mark, 32).alias("hi"))


def prefixes(numbered: DataFrame, files: DataFrame) -> DataFrame:
    """(file, digest, lines, lo, hi, whole): fingerprints of prefixes, ``whole`` that of all lines.

    ``files``: file, digest, ended.  Of a file whose last line has not ended, the prefix without it is listed, too.  Windows run over
    runs of lines, a row for every ``RUN_LINES``; sums are exact for files of up to 2**31 lines."""
    runs = _marked(numbered).groupBy("file", F.floor(F.col("line_no") / RUN_LINES).alias("run_no")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.max_by(F.struct("lo", "hi"), "line_no").alias("last"))
    upto = Window.partitionBy("file").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    sums = runs.select("file", "last", *[F.sum(c).over(upto).alias(c) for c in ("lines", "lo", "hi")],
                       F.lead("run_no").over(Window.partitionBy("file").orderBy("run_no")).isNull().alias("whole"))
    sums = sums.join(files.select("file", "digest", "ended"), "file")
    here = F.struct("lines", "lo", "hi", "whole")
    before = F.struct((F.col("lines") - 1).alias("lines"), (F.col("lo") - F.col("last.lo")).alias("lo"),
                      (F.col("hi") - F.col("last.hi")).alias("hi"), F.lit(False).alias("whole"))
    listed = F.when(F.col("whole") & ~F.col("ended") & (F.col("lines") > 1), F.array(here, before)).otherwise(F.array(here))
    return sums.select("file", "digest", F.inline(listed))


def known_lines(numbered: DataFrame, found: DataFrame, ledger: DataFrame) -> DataFrame:
    """(file, known): the length of the longest prefix of each file that ``ledger`` (``FILE_CHAINS``) knows; files without one are left out."""
    keys = ["digest", "lines", "lo", "hi"]
    entries = ledger.distinct()
    best = found.join(entries, keys, "left_semi").groupBy("file").agg(F.max(F.struct("lines", "lo", "hi")).alias("at"))
    zero = F.lit(0).cast("long")
    start = found.select("file", "digest").distinct().join(best, "file", "left").select(
        "file", "digest", *[F.coalesce(f"at.{c}", zero).alias(f"from_{c}") for c in ("lines", "lo", "hi")])
    # ends of earlier takes inside the run of lines that comes next
    ends = entries.where(F.col("lines") % RUN_LINES != 0)
    inside = start.where(F.col("from_lines") % RUN_LINES == 0).join(ends.select("digest", "lines"), "digest")
    inside = inside.where((F.col("lines") > F.col("from_lines")) & (F.col("lines") < F.col("from_lines") + RUN_LINES)).drop("lines").distinct()
    lines = _marked(numbered).select("file", "line_no", "lo", "hi").join(inside, "file").where(
        (F.col("line_no") >= F.col("from_lines")) & (F.col("line_no") < F.col("from_lines") + RUN_LINES))
    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = lines.select("file", "digest", (F.col("line_no") + 1).alias("lines"), *[(F.col(f"from_{c}") + F.sum(c).over(upto)).alias(c) for c in ("lo", "hi")])
    further = each.join(ends, keys, "left_semi").select("file", "lines")
    whole = start.where("from_lines > 0").select("file", F.col("from_lines").alias("lines"))
    return further.unionByName(whole).groupBy("file").agg(F.max("lines").alias("known"))
