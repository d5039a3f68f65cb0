"""Connected components by alternating large and small stars; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, stored

ROUNDS = 60
HUBS = 1024  # a key with more than a 1024th of the rows is a hub: there are fewer than that


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once; ``left`` has ``rows`` rows.

    Keys with over a 1024th of the rows go by broadcast of their part of ``right`` (fewer than 1024 rows),
    so no task gets the rows of a hub."""
    hubs = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") * HUBS > rows).select(key)
    hubs = F.broadcast(hubs)
    few = F.broadcast(right.join(hubs, key, "left_semi"))
    ours, rest = left.join(hubs, key, "left_semi"), left.join(hubs, key, "left_anti")
    if how == "left":
        none = rest.where(F.col(key).isNull())
        rest = rest.where(F.col(key).isNotNull())
        out = ours.join(few, key, "left").unionByName(rest.join(right, key, "left"))
        return out.unionByName(none, allowMissingColumns=True)
    return ours.join(few, key).unionByName(rest.join(right, key))


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """Edges u, v with m, the least neighbour of u; hubs by broadcast, the rest by shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    hub = F.col("degree") * HUBS > rows
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    rest = edges.join(F.broadcast(least.where(hub).select("u")), "u", "left_anti")
    return edges.join(hubs, "u").unionByName(rest.join(least.where(~hub).select("u", "m"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v of any ordered type.  Returns node and component (its least node) of all nodes with edges."""
    spark = edges.sparkSession
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = e.count()
    last = None
    for _ in range(ROUNDS if count else 0):
        # large star: the greater neighbours of a node move to its least neighbour, or to itself if it is less
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _with_least(both, 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        big = stored(big.where("u <> v").distinct(), "stars")
        # small star: a node and its lesser neighbours move to the least of them
        small = _with_least(big, big.count())
        low = small.select("u", F.col("m").alias("v"))
        n = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low).where("u <> v").distinct(), "edges")
        state = n.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        discard(big)
        discard(e)
        release(spark)
        e, count = n, state[0]
        if state == last:
            break
        last = state
    else:
        if count:
            raise RuntimeError(f"components not found in {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
