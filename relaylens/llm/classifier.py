"""Operator 7: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in tasks, and stored.  The trees are fitted in numpy on a
bounded sample of the labelled documents (``TRAIN_ROWS`` by hash of their ids; ids whose crc32 mod 5 is 0
are held out and never seen), with ``BINS`` quantile bins per statistic and logistic loss.  They are
flattened into arrays (statistic, threshold, leaf value by node) that travel to the tasks, where all documents
of a batch go down a tree at once.  Labels, language, source and id are no inputs of a score.

Cases: null and empty texts have all statistics 0 and get a score like any; very long texts are read whole;
rows that repeat a document get the same score; a label of null is no label; without labels of both kinds the score is the share
of label 1 (0.5 if there is none); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TRAIN_ROWS = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAST_WEIGHT = 4.0  # hessian in a leaf
RIDGE = 1.0
CUT = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "lower", "digit", "space", "mark", "symbol", "bang", "bar", "high",
    "distinct_words", "top_word", "repeats_next", "short_words", "symbol_ends", "upper_words", "lines_per_word", "distinct_lines",
    "top_line", "mean_line", "sentence_ends", "distinct_bytes",
)

# byte -> class
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"#*$%&<>=+~^_@/\\[]{}`", b"!?", b"|",
                             bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k + 1


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    ws = data.split()
    if not ws:
        return [0.0] * len(STATISTICS)
    n, m = len(data), len(ws)
    raw = np.frombuffer(data, dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=10) / n
    lens = np.fromiter(map(len, ws), dtype=np.int64, count=m)
    counts: dict[bytes, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts: dict[bytes, int] = {}
    for x in lines:
        line_counts[x] = line_counts.get(x, 0) + 1
    ends = np.fromiter((w[-1] for w in ws), dtype=np.int64, count=m)
    end_class = np.bincount(_CLASS[ends], minlength=10) / m
    return [
        np.log1p(n), np.log1p(m), float(lens.mean()), float(np.log1p(lens.max())), *by_class[1:10].tolist(),
        len(counts) / m, max(counts.values()) / m, sum(a == b for a, b in zip(ws, ws[1:])) / m, float((lens <= 2).mean()),
        float(end_class[6] + end_class[7]), sum(map(bytes.isupper, ws)) / m, len(lines) / m, len(line_counts) / len(lines),
        max(line_counts.values()) / len(lines), float(np.log1p(m / len(lines))), float(np.isin(ends, (46, 33, 63)).mean()), int((by_byte > 0).sum()) / 256,
    ]


def _statistics(batches):
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"),
                            "x": [statistics(t if isinstance(t, str) else None) for t in b["text"]]})


class Trees:
    """Trees as arrays: node i of a tree has children 2 i + 1 and 2 i + 2; statistic -1 stays on the left for leaves above the last level."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    share = float(y.mean()) if len(y) else 0.5
    none = Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    if not len(y) or not 0 < share < 1:
        none.base = 0.0 if not len(y) else (30.0 if share else -30.0)
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # bin <= k: value <= cut k
    k = x.shape[1]
    base = np.log(share / (1 - share))
    raw = np.full(len(y), base)
    inner, last = 2 ** depth - 1, 2 ** depth
    features, thresholds, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, last))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            cell = (node - first) * bins
            best = np.full(width, 1e-6)
            pick_f, pick_b = np.zeros(width, int), np.full(width, bins)
            for f in range(k):
                if not len(cuts[f]):
                    continue
                at = cell + binned[:, f]
                gl = np.cumsum(np.bincount(at, g, width * bins).reshape(width, bins), axis=1)
                hl = np.cumsum(np.bincount(at, h, width * bins).reshape(width, bins), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt ** 2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = -1
                gain[:, len(cuts[f]):] = -1
                b = gain.argmax(axis=1)
                got = gain[np.arange(width), b]
                better = got > best
                best[better], pick_f[better], pick_b[better] = got[better], f, b[better]
            for i in range(width):
                if pick_b[i] < bins:
                    features[t, first + i], thresholds[t, first + i] = pick_f[i], cuts[pick_f[i]][pick_b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > thresholds[t, node])
        at = node - inner
        leaves[t] = -rate * np.bincount(at, g, last) / (np.bincount(at, h, last) + RIDGE)
        raw += leaves[t][at]
    return Trees(base, features, thresholds, leaves)


def held_out(doc_id, mod: int = 5, rest: int = 0):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    x = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_statistics, "doc_id long, x array<double>"), "statistics")
    seen = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    train = x.where(~held_out(F.col("doc_id"))).join(seen, "doc_id")
    rows = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("x", "y").collect()  # at most train_rows
    k = len(STATISTICS)
    trees = fit(np.array([r["x"] for r in rows], dtype=float).reshape(-1, k), np.array([r["y"] for r in rows], dtype=float))

    def run(batches):
        for b in batches:
            p = trees.probability(np.array(b["x"].tolist(), dtype=float).reshape(-1, k))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": p})

    out = x.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
