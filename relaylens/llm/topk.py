"""Operator 5: exact top-k inner products, norm-sorted with rotated partial sums.

Vectors become integers, floor(scale * x).  All are sorted by descending length and cut into blocks.
Queries get a first k-th best score from the block of the longest vectors; a block of candidates meets a
block of queries only if the product of their largest lengths can reach the lowest of those scores
(Cauchy-Schwarz).  Inside a meeting both sides are rotated by the right singular vectors of a sample, so that
most of a product lies in the first coordinates; pairs whose partial sum plus the product of the lengths of
the rest stays below the query's k-th best score are dropped, the others get their exact product.
Rotation and bounds only save work: results are exact, whatever the sample.

Cases: rows whose id is null, whose vector is null or empty or holds null or non-finite components take
no part; shorter vectors count as padded with zeros; a query's own id is never its candidate, also where
the id repeats; ties go to the smaller id; rows that repeat another id's vector are candidates of their
own; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, stored

SCALE = 256
EVERY = 50
K = 5
BLOCK = 4096
QUERY_BLOCK = 1024
SAMPLE = 4096  # vectors that the rotation is fitted on
HEAD = 4  # the first 1/HEAD of the rotated coordinates make the partial sum


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long), norm."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad).select(
        F.col("vec_id").cast("long"), v.alias("v")).withColumn("norm", F.sqrt(square))


def _blocks(dim: int, size: int):
    def run(batches):
        ids, rows, norms = [], [], []

        def out(n):
            m = np.zeros((n, dim), dtype="<i8")
            for i, r in enumerate(rows[:n]):
                m[i, : len(r)] = r
            yield pd.DataFrame({"max_norm": [max(norms[:n])], "n": [n], "ids": [np.array(ids[:n], dtype="<i8").tobytes()], "m": [m.tobytes()]})
            del ids[:n], rows[:n], norms[:n]

        for b in batches:
            ids += b["vec_id"].tolist()
            rows += b["v"].tolist()
            norms += b["norm"].tolist()
            while len(ids) >= size:
                yield from out(size)
        if ids:
            yield from out(len(ids))

    return run


def _packed(df: DataFrame, dim: int, size: int, parts: int) -> DataFrame:
    order = [F.col("norm").desc(), F.xxhash64("vec_id")]
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(_blocks(dim, size), "max_norm double, n int, ids binary, m binary").withColumn(
        "block", F.monotonically_increasing_id())


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All products of integer rows: by doubles where they are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:
        return (q.astype("f8") @ c.astype("f8").T).astype("i8")
    return q @ c.T


def _meeting(dim: int, k: int, rotation: np.ndarray):
    head = max(1, dim // HEAD)

    def best(q_ids, q, lows, c_ids, c):
        """Rows query, vec_id, score of each query's k best here that reach its low."""
        qf, cf = q.astype("f8") @ rotation, c.astype("f8") @ rotation
        rest = np.linalg.norm(qf[:, head:], axis=1)[:, None] * np.linalg.norm(cf[:, head:], axis=1)[None, :]
        bound = qf[:, :head] @ cf[:, :head].T + rest
        slack = 1e-9 * np.linalg.norm(qf, axis=1)[:, None] * max(1.0, float(np.linalg.norm(cf, axis=1).max(initial=0))) + 1e-6
        alive = bound + slack >= lows[:, None]
        alive &= q_ids[:, None] != c_ids[None, :]
        some = alive.any(axis=0)
        if not some.any():
            return
        c, c_ids, alive = c[some], c_ids[some], alive[:, some]
        score = _exact(q, c)
        for i in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[i])
            s = score[i, at]
            if len(at) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                at, s = at[s >= kth], s[s >= kth]
            at = at[np.lexsort((c_ids[at], -s))][:k]
            yield q_ids[i], c_ids[at], score[i, at]

    def run(batches):
        for b in batches:
            qs, ids, scores = [], [], []
            for r in b.itertuples(index=False):
                q_ids, q = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_m, "<i8").reshape(-1, dim)
                c_ids, c = np.frombuffer(r.c_ids, "<i8"), np.frombuffer(r.c_m, "<i8").reshape(-1, dim)
                lows = np.frombuffer(r.lows, "<f8") if r.lows is not None else np.full(len(q), -np.inf)
                for qi, ci, s in best(q_ids, q, lows, c_ids, c):
                    qs.append(np.full(len(ci), qi))
                    ids.append(ci)
                    scores.append(s)
            if qs:
                yield pd.DataFrame({"query_id": np.concatenate(qs), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    return run


def _lows(dim: int, k: int, rotation: np.ndarray):
    """Each query block with the k-th best score of its queries in the first candidate block."""
    meet = _meeting(dim, k, rotation)

    def run(batches):
        for b in batches:
            out = []
            for i in range(len(b)):
                ids = np.frombuffer(b["q_ids"].iloc[i], "<i8")
                low = np.full(len(ids), -np.inf)
                for got in meet([b.iloc[i:i + 1].assign(lows=None)]):
                    kth = got.groupby("query_id")["score"].agg(["size", "min"])
                    kth = kth[kth["size"] >= k]["min"].to_dict()
                    low = np.array([kth.get(x, -np.inf) for x in ids.tolist()], dtype="f8")
                out.append(low.tobytes())
            yield pd.DataFrame({"q_block": b["q_block"], "q_norm": b["q_norm"], "q_ids": b["q_ids"], "q_m": b["q_m"], "lows": out,
                                "low": [float(np.frombuffer(x, "<f8").min()) for x in out]})

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all rows."""
    spark = vectors.sparkSession
    v = stored(integer_vectors(vectors, scale), "vectors")
    n, dim = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).head()
    parts = max(1, min(bucket(spark), -(-n // BLOCK)))
    dim = dim or 1
    sample = np.zeros((SAMPLE, dim))
    # a bounded sample: SAMPLE vectors of dim components
    for i, r in enumerate(v.select("vec_id", "v").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()):
        sample[i, : len(r["v"])] = r["v"]
    rotation = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
    schema = "query_id long, vec_id long, score long"
    c = stored(_packed(v, dim, BLOCK, parts), "candidates").select(
        F.col("block").alias("c_block"), F.col("max_norm").alias("c_norm"), F.col("ids").alias("c_ids"), F.col("m").alias("c_m"))
    queries = v.where(F.col("vec_id") % every == 0)
    q = stored(_packed(queries, dim, QUERY_BLOCK, max(1, parts // every)), "queries").select(
        F.col("block").alias("q_block"), F.col("max_norm").alias("q_norm"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    longest = c.orderBy(F.col("c_norm").desc(), "c_block").limit(1)  # one block
    first = q.crossJoin(F.broadcast(longest)).drop("c_block", "c_norm").mapInPandas(
        _lows(dim, k, rotation), "q_block long, q_norm double, q_ids binary, q_m binary, lows binary, low double")
    first = stored(first, "lows")
    # the stated query set against all rows, block by block, as far as lengths allow; the lists hold no vectors
    pairs = first.select("q_block", "q_norm", "low").join(
        F.broadcast(c.select("c_block", "c_norm")), F.col("q_norm") * F.col("c_norm") * (1 + 1e-9) + 1e-6 >= F.col("low"))
    pairs = pairs.select("q_block", "c_block").repartition(bucket(spark), "q_block", "c_block")
    meets = pairs.join(first.drop("q_norm", "low"), "q_block").join(c.drop("c_norm"), "c_block")
    got = meets.repartition(bucket(spark), "q_block", "c_block").select("q_ids", "q_m", "lows", "c_ids", "c_m").mapInPandas(
        _meeting(dim, k, rotation), schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return got.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
