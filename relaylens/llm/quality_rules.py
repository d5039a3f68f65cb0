"""Operator 4: quality rules by a hashed n-gram log-likelihood ratio (DataFrame functions only).

Words, the last ``SUFFIX`` characters of words and pairs of neighbouring words are hashed into ``BUCKETS`` cells.  Two multinomials over the
cells are estimated, with ``SMOOTH`` added to every cell: of the trusted target (documents whose label
``quality`` is 1) and of the raw corpus (all documents).  A document's score is the sum of
log(target / raw) over its n-grams divided by their number; it is kept if the score is at least
``THRESHOLD`` and no base rule fails.  All documents count and all are scored, over whole texts.

Base rules: fewer than 50 words, or more than half of the words inside repeated windows of 3 words.

Cases: null and empty texts have no words and fail the base rules; very long texts are treated whole;
repeated rows are rows of their own; a document with labels of both kinds counts as target; an empty table
gives no rows; other columns don't matter.  Without any target document every score is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

BUCKETS = 8192
SMOOTH = 1.0
SUFFIX = 3
THRESHOLD = -0.3
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
BROADCAST_ROWS = 2_000_000  # of (id, flag), about 50 MB in memory


def _cell(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _cells(w: Column) -> Column:
    """Cells of a document's words, word ends and pairs of neighbours."""
    pairs = F.transform(w, lambda x, i: F.when(i > 0, _cell(F.get(w, i - 1), x)).otherwise(F.lit(-1)))
    ends = F.transform(w, lambda x: _cell(F.substring(x, -SUFFIX, SUFFIX), F.lit(1)))
    return F.concat(F.transform(w, lambda x: _cell(x)), ends, F.array_remove(pairs, -1))


def _windows(w: Column) -> Column:
    """64-bit hashes of a text's windows of 3 words; null if there is none."""
    n = F.size(w)
    return F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: the length of the union of their spans."""
    found = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
        F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    at = F.sort_array(F.transform(let(placed, found), lambda x: x["i"]))
    step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).cast("long").alias("n"))
    return F.aggregate(at, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), step)["n"]


def _measures(text: Column, w: Column, ratios: Column) -> Column:
    """All counts and the score of a text with the words w, as a struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    none = F.lit(0).cast("long")
    repeats = let(_windows(w), lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), none).otherwise(_covered(h)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(ratios, x))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        let(_cells(w), lambda c: F.when(F.size(c) > 0, total(c) / F.size(c)).otherwise(F.lit(0.0))).alias("score"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target / raw) of every cell: ``BUCKETS`` numbers, whatever the size of the corpus."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("trusted_id")).distinct()
    few = trusted.count() <= BROADCAST_ROWS
    d = docs.select("doc_id", words(F.col("text")).alias("w"))
    d = d.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    n = d.select(F.col("trusted_id").isNotNull().alias("t"), F.explode(let(F.col("w"), _cells)).alias("c"))
    n = n.groupBy("c").agg(F.count(F.lit(1)).alias("raw"), F.count_if("t").alias("target"))
    raw, target = [SMOOTH] * BUCKETS, [SMOOTH] * BUCKETS
    for r in n.collect():  # one row per cell
        raw[r["c"]] += r["raw"]
        target[r["c"]] += r["target"]
    if sum(target) <= SMOOTH * BUCKETS:
        return [0.0] * BUCKETS
    import math

    shift = math.log(sum(raw) / sum(target))
    return [math.log(t / r) + shift for t, r in zip(target, raw)]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, document (all columns of ``docs`` as a struct), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    ratios = F.split(F.lit(",".join(repr(round(x, 9)) for x in log_ratios(docs, labels))), ",").cast("array<double>")
    measures = let(words(F.col("text")), lambda w: _measures(F.coalesce(F.col("text"), F.lit("")), w, ratios))
    d = docs.select("doc_id", "text", F.struct("*").alias("document")).withColumn("m", measures).select("doc_id", "text", "document", "m.*")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
