"""Operator 9: mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source should appear ``rate = target / source_size`` times.  The integral part is
certain; the fractional part is rounded by the pivotal method: two documents with fractional
probabilities meet and mass, counted in words, moves at random from one to the other until one is 0
or 1; the other goes on to the next meeting.  A meeting changes no probability on average and leaves
the number of words as it is, so a source's words miss its target by half a document at most.
Meetings take place in buckets of about ``FANOUT`` documents, the longest first; what is left of each bucket, at most one
document, is dealt to the next level of a tree of buckets, until one per source is left.

Cases: a null text or one without words has size 0; the null source is a source like any other and
sorts last; a document id may repeat or be null (such rows are dealt by row, not by id); an empty
table gives no rows; other columns don't matter.  Random numbers are hashes of document ids
(and of row numbers for ids that repeat), so reruns on a table agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, stored, unit_interval

FANOUT = 256
CAP = 3
WEIGHTS = (5, 2, 1)
EPS = 1e-9


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(
        "*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source_size, n_docs, target.

    Targets fill up like water: ``min(cap * size, level * weight)`` with the level at which they add up
    to the size of all sources.  Sources in order of the level at which they reach their cap; the
    capped ones are a prefix of that order."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by = by.withColumn("fills_at", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("total", F.sum("source_size").over(everything))
    by = by.withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.col("weights_left"))
    # the level that holds is that of the first source it doesn't fill
    by = by.withColumn("at", F.row_number().over(Window.orderBy("fills_at", F.col("source").asc_nulls_last())))
    first = F.min(F.when(F.col("level") <= F.col("fills_at") + EPS, F.struct("at", "level"))).over(everything)
    by = by.withColumn("level", first["level"])
    return by.select("source", "source_size", "n_docs",
                     F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _meet(acc: Column, x: Column) -> Column:
    """One meeting of the pivotal method: acc.cur (null at first) and x; decided units go to acc.done."""
    a, b = acc["cur"], x
    room = lambda u, up: F.when(F.lit(up), (1 - u["p"]) * u["size"]).otherwise(u["p"] * u["size"])
    to_a, to_b = F.least(room(a, True), room(b, False)), F.least(room(a, False), room(b, True))
    moved = F.when(unit_interval(a["key"], b["key"], F.lit(9)) < to_b / (to_a + to_b), to_a).otherwise(-to_b)
    a2 = a.withField("p", a["p"] + moved / a["size"])
    b2 = b.withField("p", b["p"] - moved / b["size"])
    return F.when(a.isNull(), F.struct(acc["done"].alias("done"), b.alias("cur"))).otherwise(
        let(F.struct(a2.alias("a"), b2.alias("b")), lambda m: _settle(acc["done"], m["a"], m["b"])))


def _settle(done: Column, a: Column, b: Column) -> Column:
    """The one nearer to 0 or 1 is decided; so is the other if it got there too."""
    off = lambda u: F.least(u["p"], 1 - u["p"])
    decided = lambda u: u.withField("won", (u["p"] > 0.5).cast("int"))
    a_first = off(a) <= off(b)
    both = F.greatest(off(a), off(b)) < EPS
    goes_on = F.when(a_first, b).otherwise(a)
    return F.when(both, F.struct(F.concat(done, F.array(decided(a), decided(b))).alias("done"), F.when(F.lit(False), b).alias("cur"))).otherwise(
        F.struct(F.concat(done, F.array(decided(F.when(a_first, a).otherwise(b)))).alias("done"), goes_on.alias("cur")))


def copies(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, fanout: int = FANOUT) -> DataFrame:
    """``sizes``: rid (unique), doc_id, source, size, stored.  Returns rid, doc_id, source, size, source_size, target, copies."""
    targets = stored(source_targets(sizes, weights, cap), "targets")
    widest = targets.agg(F.max("n_docs")).head()[0] or 0
    repeated = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("doc_id").alias("again"), F.lit(True).alias("is_again"))
    rows = sizes.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left").drop("again")
    # a source is a join key here: null is a source too
    t = targets.select(F.col("source").alias("of"), "source_size", "n_docs", "target")
    rows = rows.join(F.broadcast(t) if targets.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64("doc_id", F.when(F.col("is_again"), F.col("rid")))
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(cap)))).withColumn("whole", F.floor(F.col("rate") + EPS))
    rows = rows.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).withColumn("key", key)
    keep = ["rid", "doc_id", "source", "size", "source_size", "target"]
    certain = (F.col("p") < EPS) | (F.col("size") == 0)
    settled = rows.where(certain).select(*keep, F.col("whole").cast("int").alias("copies"))
    open_ = rows.where(~certain).select(
        "source", F.pmod("key", F.ceil(F.col("n_docs") / fanout)).alias("b"),
        F.struct("size", "key", "rid", "doc_id", "source_size", "target", "whole", "p", F.lit(0).alias("won")).alias("x"))
    parts = [settled]
    buckets = -(-widest // fanout)
    while True:
        met = open_.groupBy("source", "b").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
        met = met.select("source", "b", F.aggregate(
            "xs", F.struct(F.slice("xs", 1, 0).alias("done"), F.when(F.lit(False), F.element_at("xs", 1)).alias("cur")), _meet).alias("m"))
        met = stored(met, "pivotal")
        done = met.select("source", F.explode("m.done").alias("x"))
        parts.append(_out(done, F.col("x.won"), keep))
        left = met.where(F.col("m.cur").isNotNull()).select("source", F.floor(F.col("b") / fanout).alias("b"), F.col("m.cur").alias("x"))
        if buckets <= 1:
            # the last document of each source: rounded to the nearer side
            parts.append(_out(left, (F.col("x.p") > 0.5).cast("int"), keep))
            break
        open_, buckets = left, -(-buckets // fanout)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _out(df: DataFrame, won: Column, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c == "source" else F.col(f"x.{c}").alias(c) for c in keep],
                     (F.col("x.whole") + won).cast("int").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source of every document."""
    sizes = stored(document_sizes(docs.select("doc_id", "source", "text")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "size"), "sizes")
    return copies(sizes, weights, cap).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of ``docs``."""
    whole = docs.select("doc_id", "source", "text", F.struct("*").alias("document"))
    whole = document_sizes(whole).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "size", "document")
    whole = stored(whole, "mix-documents")
    got = copies(whole.drop("document"), weights, cap).where("copies > 0").select("rid", "copies")
    many = whole.select("rid", "document").join(got, "rid")
    return many.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")
