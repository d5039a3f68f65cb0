"""Operator 1: language-model scores by a causal self-attention model in numpy over subword ids.

The model.  A token's probability is a mixture of ``CLASSES`` distributions over the vocabulary; one layer
of causal self-attention over the ids before it gives the mixture's weights.  Class k's distribution after an id is
that of the ids that follow it (all pairs, smoothed by overall shares), bent
towards the ids that stand ``LAG`` places behind ids of class k and divided by its sum, so that it stays a
distribution.  Counts come from all training tokens; classes, which come out as languages and styles, from k-means over what stands
``LAG`` places behind the ``CLASSED`` most frequent ids.  The attention starts as a vote of the classes of the ids before.  The attention's weights are
fitted by gradient descent: each task fits the common weights on its share of the training documents, all their ids in
windows side by side, and the tasks' weights are averaged in a tree, ``ROUNDS`` times.  Each document has its round, so
the rounds together are one pass over all training text.  Texts are encoded once; ids are stored.

Counts of pairs of the ``PAIRED`` most frequent ids travel to the tasks (a fixed number).  Documents are scored in
chunks of about ``CHUNK_IDS`` ids; all other pairs of a chunk, each once, meet their counts in a join.

Scoring.  A document's ids and one end id run through windows of ``WINDOW`` ids that overlap; each window
scores the ids that no window before it has scored.

The base is a unigram model over words with one added to all counts.  Word counts are made by a shuffle; the
most frequent words' counts travel to the tasks (at most ``TOP_WORDS``), all other words of a document
meet their counts in a join.

Cases: null and empty texts are the end alone; very long texts are scored whole, in windows; repeated rows
are rows of their own, in training too; a null id is no held-out id (its remainder is null); words with counts
around the ``TOP_WORDS`` limit meet them in the join, with the same result; without training documents the weights stay as they start and all
counts are 0; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from itertools import filterfalse, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import batches_of, bucket, discard, release, stored

CLASSES = 32
CLASSED = 4096
PAIRED = 2048
OWN_ROWS = 3840  # ids with input vectors of their own; the others share SHARED_ROWS
SHARED_ROWS = 256
DIM = 16
WINDOW = 32
STRIDE = 24
LAG = 4
VOTE = 4.0
ROUNDS = 2
SHARE = 50_000  # windows that are shuffled and fitted together
TOP_WORDS = 1 << 18
FLUSH_WORDS = 200_000
FLUSH_IDS = 2_000_000
CHUNK_IDS = 1 << 16
BATCH_BYTES = 4 << 20  # of a table that reach Python at once
PAIRS_OUT = 100_000  # pairs that leave Python at once
SMOOTH = 20.0
BATCH = 128  # windows at once
FIT_BATCH = 48
RATE = 0.01
MOD, REST = 7, 2

_A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split parts at space and the characters 9 to 13."""
    return text.encode().translate(_A_TO_Z).split() if isinstance(text, str) else []


def _mask(first: int, width: int) -> np.ndarray:
    """Places do not attend to later ones."""
    key = (first, width)
    if key not in _MASKS:
        _MASKS[key] = np.where(np.arange(width)[None, :] > np.arange(first, width)[:, None], np.float32(-1e9), np.float32(0))
    return _MASKS[key]


_MASKS: dict[tuple[int, int], np.ndarray] = {}


TOP_LOGIT = np.float32(60)


def _exp(logits: np.ndarray) -> np.ndarray:
    """Exponentials up to a factor for each row, in place."""
    most = logits
    while (n := most.shape[2]) > 1:  # halves against each other: numpy's own maximum of short rows takes four times as long
        most = np.maximum(most[:, :, :n // 2], most[:, :, n - n // 2:]) if n % 2 == 0 else most.max(axis=2, keepdims=True)
    logits -= most
    return np.exp(logits, out=logits)


class Attention:
    """The weights, as one vector of floats with views into it."""

    SHAPES = {"E": (OWN_ROWS + SHARED_ROWS, DIM), "P": (WINDOW, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM),
              "U": (DIM, CLASSES), "B": (CLASSES, CLASSES)}

    def __init__(self, flat: np.ndarray | None = None):
        n = sum(a * b for a, b in self.SHAPES.values())
        if flat is None:
            rng = np.random.default_rng(7)
            flat = rng.normal(0, 0.1, n).astype(np.float32)
        self.flat, at = flat, 0
        for name, (a, b) in self.SHAPES.items():
            setattr(self, name, flat[at: at + a * b].reshape(a, b))
            at += a * b

    @classmethod
    def start(cls, row: np.ndarray, kind: np.ndarray) -> Attention:
        """Ids have vectors of their classes; attention to all places alike; a class has the logit of its share of them."""
        m, rng = cls(), np.random.default_rng(3)
        m.flat *= 0.3
        wide = max(CLASSES, DIM)
        of_class = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:CLASSES, :DIM]
        of_class /= np.linalg.norm(of_class, axis=1, keepdims=True)
        own = np.flatnonzero(row < OWN_ROWS)
        m.E[row[own]] += of_class[kind[own]].astype(np.float32)
        m.V[:] = m.O[:] = np.eye(DIM, dtype=np.float32)
        m.U[:] = VOTE * of_class.T
        m.B[:] = 0
        return m

    def forward(self, rows: np.ndarray, classes: np.ndarray, first: int = 0):
        """Mixture weights of places ``first`` on of windows (n, w) of input rows and classes of the ids before."""
        w = rows.shape[1]
        x = self.E[rows] + self.P[:w]
        q, k, v = x @ self.Q, x @ self.K, x @ self.V
        s = q[:, first:] @ k.transpose(0, 2, 1)
        s *= np.float32(DIM ** -0.5)
        s += _mask(first, w)
        _exp(s)
        s /= s.sum(axis=2, keepdims=True)
        c = s @ v
        h = x[:, first:] + c @ self.O
        z = h @ self.U
        z += self.B[classes[:, first:]]
        _exp(z)
        z /= z.sum(axis=2, keepdims=True)
        return z, (x, q, k, v, s, c, h)

    def tables(self, row: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``mixture`` looks up: queries, keys and values of input rows and places, the last with a one behind
        them; logits that an id alone gives; the map from attended values to logits."""
        one = np.ones((len(self.E), 1), np.float32)
        scale = np.float32(DIM ** -0.5)
        by_row = np.concatenate([self.E @ self.Q * scale, self.E @ self.K, self.E @ self.V, one], axis=1)
        by_place = np.concatenate([self.P @ self.Q * scale, self.P @ self.K, self.P @ self.V, np.zeros((WINDOW, 1), np.float32)], axis=1)
        return by_row, by_place, (self.E @ self.U)[row] + self.B[kind], self.P @ self.U, self.O @ self.U

    @staticmethod
    def mixture(tables, rows: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
        """``forward`` for scoring: the mixture's weights of places ``first`` on, but for a factor at each place.

        Logits beyond ``TOP_LOGIT`` count as that, which keeps sums finite and above 0 without a search for the largest."""
        by_row, by_place, logits, logits_by_place, attended = tables
        t = by_row[rows]
        t += by_place
        s = t[:, first:, :DIM] @ t[:, :, DIM:2 * DIM].transpose(0, 2, 1)
        np.clip(s, -TOP_LOGIT, TOP_LOGIT, out=s)
        s += _mask(first, WINDOW)
        np.exp(s, out=s)
        c = s @ t[:, :, 2 * DIM:]
        z = ((c[:, :, :DIM] / c[:, :, DIM:]).reshape(-1, DIM) @ attended).reshape(*c.shape[:2], CLASSES)
        z += logits[ids[:, first:]]
        z += logits_by_place[first:]
        return np.exp(np.clip(z, -TOP_LOGIT, TOP_LOGIT, out=z), out=z)

    def gradient(self, rows, classes, theta, weight):
        """Gradient of the mean negative log probability; theta (n, w, classes): the classes' probabilities of the targets."""
        pi, (x, q, k, v, a, c, h) = self.forward(rows, classes)
        p = (pi * theta).sum(axis=2, keepdims=True)
        dz = theta / p
        np.subtract(1, dz, out=dz)
        dz *= pi
        dz *= (weight / max(1.0, float(weight.sum())))[:, :, None]
        g = Attention(np.zeros_like(self.flat))
        flat = lambda t: t.reshape(-1, t.shape[-1])
        g.U[:] = flat(h).T @ flat(dz)
        order = np.argsort(classes.astype(np.int16), axis=None, kind="stable")  # small numbers are sorted by their digits
        cs = classes.ravel()[order]
        edge = np.flatnonzero(np.concatenate([[True], cs[1:] != cs[:-1]]))
        g.B[cs[edge]] = np.add.reduceat(flat(dz)[order], edge, axis=0)
        dh = dz @ self.U.T
        g.O[:] = flat(c).T @ flat(dh)
        dc = dh @ self.O.T
        dv = a.transpose(0, 2, 1) @ dc
        da = dc @ v.transpose(0, 2, 1)
        da -= (da * a).sum(axis=2, keepdims=True)
        da *= a
        da *= np.float32(DIM ** -0.5)
        ds = da
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g.Q[:], g.K[:], g.V[:] = flat(x).T @ flat(dq), flat(x).T @ flat(dk), flat(x).T @ flat(dv)
        dx = dh + dq @ self.Q.T + dk @ self.K.T + dv @ self.V.T
        g.P[: rows.shape[1]] = dx.sum(axis=0)
        order = np.argsort(rows.astype(np.int16), axis=None, kind="stable")
        rs = rows.ravel()[order]
        edge = np.flatnonzero(np.concatenate([[True], rs[1:] != rs[:-1]]))
        g.E[rs[edge]] = np.add.reduceat(flat(dx)[order], edge, axis=0)
        return g.flat, -float((np.log(p[:, :, 0]) * weight).sum())


def ids_before(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The id before each id of a stream of documents."""
    before = np.concatenate([[end], ids[:-1]])
    before[np.cumsum(lengths) - lengths] = end
    return before


class Model:
    """Attention and the counts: input row and class by id; ``tables`` as ``class_probabilities`` makes them."""

    def __init__(self, row, kind, tables, attention):
        self.row, self.kind, self.attention = row, kind, attention
        self.theta, self.overall, self.place, self.after, self.spare, self.sums, self.one = tables

    def given(self, x: np.ndarray, t: np.ndarray, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of t after x by class, but for a factor (the second) that all classes share.

        rare: counts of the pairs that ``after`` has not; the first result does without."""
        pair = self.after[self.place[x], self.place[t]] + self.spare[x] * self.overall[t]
        if rare is not None:
            pair += rare * self.one[x]
        return self.by_class(x, t), pair / self.overall[t]

    def by_class(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The first result of ``given`` alone: all that fitting needs."""
        out = self.theta.take(t, axis=0)
        out *= self.sums.take(x, axis=0)
        return out

    def windows(self, ids: np.ndarray, lengths: np.ndarray):
        """Window starts in the stream of documents, and for each how many of its first places are scored already, and its length."""
        ends = np.cumsum(lengths)
        begin = ends - lengths
        n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(lengths)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[doc] + at * STRIDE
        return start, np.where(at > 0, WINDOW - STRIDE, 0), np.minimum(WINDOW, ends[doc] - start), doc

    def score(self, ids: np.ndarray, lengths: np.ndarray, end: int, rare: np.ndarray) -> np.ndarray:
        """log10 probability of each document in the stream; rare: for each id ``given``'s count of it and the one before."""
        before = ids_before(ids, lengths, end)
        start, scored, long, doc = self.windows(ids, lengths)
        tables = self.attention.tables(self.row, self.kind)
        ones = np.ones(CLASSES, np.float32)
        out = np.zeros(len(lengths))
        for kind in (0, WINDOW - STRIDE):  # first windows score all their places
            mine = np.flatnonzero(scored == kind)
            for s in range(0, len(mine), BATCH):
                w = mine[s:s + BATCH]
                place = start[w][:, None] + np.arange(WINDOW)[None, :]
                inside = np.arange(WINDOW)[None, :] < long[w][:, None]
                place = np.where(inside, place, start[w][:, None])
                x = before[place]
                weights = Attention.mixture(tables, self.row[x], x, kind)
                by_class, factor = self.given(x[:, kind:], ids[place[:, kind:]], rare[place[:, kind:]])
                lp = np.log10(np.einsum("nwk,nwk->nw", weights, by_class) / (weights @ ones) * factor)
                out += np.bincount(doc[w], (lp * inside[:, kind:]).sum(axis=1, dtype=np.float64), minlength=len(out))
        return out


def fit_windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a document in windows side by side: the ids before, the ids, and each window's number of them."""
    n = -(-len(ids) // WINDOW)
    t = np.pad(ids, (0, n * WINDOW - len(ids)))
    x = np.concatenate([np.array([end], t.dtype), t[:-1]])
    return x.reshape(n, WINDOW), t.reshape(n, WINDOW), np.minimum(WINDOW, len(ids) - WINDOW * np.arange(n))


def fit_share(model: Model, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> None:
    """Gradient descent (Adam) over windows (``fit_windows`` of each document), in place."""
    x, t, n = (np.concatenate(c) for c in zip(*windows))
    order = np.random.default_rng(seed).permutation(len(x))
    a = model.attention
    m, v, steps = np.zeros_like(a.flat), np.zeros_like(a.flat), 0
    step, size = np.empty_like(a.flat), np.empty_like(a.flat)
    for s in range(0, len(order), FIT_BATCH):
        w = order[s:s + FIT_BATCH]
        weight = (np.arange(WINDOW)[None, :] < n[w][:, None]).astype(np.float32)
        before = x[w].astype(np.int64)
        g, _ = a.gradient(model.row[before], model.kind[before], model.by_class(before, t[w].astype(np.int64)), weight)
        steps += 1
        np.subtract(g, m, out=step)
        step *= 0.1
        m += step
        g *= g
        g -= v
        g *= 0.01
        v += g
        np.divide(m, 1 - 0.9 ** steps, out=step)
        step *= RATE
        np.divide(v, 1 - 0.99 ** steps, out=size)
        np.sqrt(size, out=size)
        size += 1e-6
        step /= size
        a.flat -= step


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(MOD)) == REST, F.lit(False))


def _encoded(path: str, end: int):
    """Every document's ids and its end, as 16- or 32-bit numbers: encoded once, read by all later passes."""
    def run(batches):
        enc, last = tokens.encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            ids = [np.frombuffer(enc.encode(t if isinstance(t, str) else None) + last, "<u4").astype(_narrow(end)).tobytes() for t in b["text"]]
            yield b.drop(columns="text").assign(ids=ids)

    return run


def _narrow(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def _word_counts(batches):
    """Word counts, the end as an empty word."""
    tokens.forget()
    words = Counter()

    def out():
        got = pd.DataFrame({"word": list(words), "n": list(words.values())})
        words.clear()
        return got

    for b in batches:
        for text in b["text"]:
            words.update(text_words(text))
            words[b""] += 1
            if len(words) >= FLUSH_WORDS:
                yield out()
    if words:
        yield out()


def _pair_counts(vocabulary: int, end: int):
    """Counts of pairs of an id and the one before (lag 1) or ``LAG`` places before; before a text stand ends."""
    def run(batches):
        tokens.forget()
        ids, size = [], 0

        def out():
            t = np.concatenate(ids).astype(np.int64)
            for lag in (1, LAG):
                first = np.full(lag, end, _narrow(end))
                before = np.concatenate([np.concatenate([first, x])[: len(x)] for x in ids]).astype(np.int64)
                before *= vocabulary
                before += t
                p, n = np.unique(before, return_counts=True)
                del before
                for s in range(0, len(p), PAIRS_OUT):
                    yield pd.DataFrame({"lag": lag, "pair": p[s:s + PAIRS_OUT], "n": n[s:s + PAIRS_OUT]})
            ids.clear()

        for b in batches:
            for x in b["ids"]:
                ids.append(np.frombuffer(x, _narrow(end)))
                size += len(ids[-1])
                if size >= FLUSH_IDS:
                    yield from out()
                    size = 0
        if ids:
            yield from out()

    return run


def _fit(shared, end: int, flat: np.ndarray, part: int):
    def run(batches):
        model, seen, windows, size = Model(*shared.value, Attention(flat.copy())), 0, [], 0
        for b in batches:
            for key, x in zip(b["k1"], b["ids"]):
                if key % ROUNDS != part:
                    continue
                windows.append(fit_windows(np.frombuffer(x, _narrow(end)), end))
                seen += int(windows[-1][2].sum())
                size += len(windows[-1][2])
                if size >= SHARE:
                    fit_share(model, windows, seen)
                    windows, size = [], 0
        if windows:
            fit_share(model, windows, seen)
        if seen:
            yield pd.DataFrame({"weight": [float(seen)], "flat": [model.attention.flat.tobytes()]})

    return run


def _mean(batches):
    total, weight = None, 0.0
    for b in batches:
        for w, f in zip(b["weight"], b["flat"]):
            x = np.frombuffer(f, np.float32) * np.float64(w)
            total, weight = x if total is None else total + x, weight + w
    if weight:
        yield pd.DataFrame({"weight": [weight], "flat": [(total / weight).astype(np.float32).tobytes()]})


def _averaged(fitted: DataFrame, start: np.ndarray) -> np.ndarray:
    """The weighted mean, 32 rows to one until 32 are left."""
    fitted = stored(fitted, "weights")
    n = fitted.count()
    while n > 32:
        n = -(-n // 32)
        fitted = stored(fitted.repartition(n).mapInPandas(_mean, "weight double, flat binary"), "weights")
    rows = fitted.collect()
    total = sum(r["weight"] for r in rows)
    return start if not rows else sum(np.frombuffer(r["flat"], np.float32) * (r["weight"] / total) for r in rows).astype(np.float32)


def _row(**arrays: np.ndarray) -> pd.DataFrame:
    """One row of arrays as bytes: a row for each number would take the driver a hundred times their size."""
    return pd.DataFrame({name: [a.tobytes()] for name, a in arrays.items()})


def _cells(width: int, kind):
    def run(batches):
        for b in batches:
            if len(b):
                yield _row(at=(b["i"].to_numpy() * width + b["j"].to_numpy()).astype(np.int32), n=b["n"].to_numpy().astype(kind))

    return run


def _gathered(counts: DataFrame, shape: tuple[int, int], kind) -> np.ndarray:
    """A table of fixed size from its cells (row, column, number), packed where they are counted."""
    out = np.zeros(shape, kind)
    cells = counts.select(*[F.col(c).cast("long").alias(name) for c, name in zip(counts.columns, "ijn")])
    for r in cells.mapInPandas(_cells(shape[1], kind), "at binary, n binary").collect():
        out.reshape(-1)[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], kind)
    return out


def id_classes(pairs: DataFrame, vocabulary: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Input row and class of every id, from counts of pairs: k-means over square roots of shares of ids behind."""
    next_to, behind = pairs.where("lag = 1"), pairs.where(F.col("lag") == LAG)
    prev = F.floor(F.col("pair") / vocabulary)
    n = _gathered(next_to.groupBy(F.pmod("pair", F.lit(vocabulary)).alias("id"), F.lit(0).alias("c")).agg(F.sum("n").alias("n")), (vocabulary, 1), np.int64)[:, 0]
    found = np.flatnonzero(n)
    top = found[np.lexsort((found, -n[found]))]
    row = OWN_ROWS + np.arange(vocabulary) % SHARED_ROWS
    row[top[:OWN_ROWS]] = np.arange(min(OWN_ROWS, len(top)))
    kind = np.full(vocabulary, CLASSES - 1)
    rank = np.full(vocabulary, -1)
    rank[top[:CLASSED]] = np.arange(min(CLASSED, len(top)))
    spark = pairs.sparkSession
    ranks = spark.createDataFrame(pa.table({"prev": top[:CLASSED], "r": np.arange(min(CLASSED, len(top)), dtype=np.int32)}))  # Arrow tables take no Python workers
    cells = behind.select(prev.alias("prev"), F.pmod(F.col("pair") % vocabulary, F.lit(256)).alias("c"), "n").join(F.broadcast(ranks), "prev")
    x = np.sqrt(_gathered(cells.groupBy("r", "c").agg(F.sum("n").alias("n")), (CLASSED, 256), np.float64))
    mass = np.square(x).sum(axis=1)
    x /= np.sqrt(np.maximum(mass, 1e-9))[:, None]
    live = np.flatnonzero(mass > 0)
    if len(live) > CLASSES:
        k = CLASSES - 1
        centre = x[live[np.linspace(0, min(len(live), 1024) - 1, k).astype(int)]]
        for _ in range(15):
            near = (x[live] @ centre.T).argmax(axis=1)
            for j in range(k):
                if (near == j).any():
                    c = (x[live[near == j]] * np.sqrt(mass[live[near == j]])[:, None]).sum(axis=0)
                    centre[j] = c / max(1e-9, np.linalg.norm(c))
        kind[top[live]] = (x[live] @ centre.T).argmax(axis=1)
    elif len(live):
        kind[top[live]] = np.arange(len(live)) % CLASSES
    return row, kind


def class_probabilities(pairs: DataFrame, kind: np.ndarray, row: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
    """The model's count tables.

    theta (id, class): shares of ids ``LAG`` places behind ids of a class; overall: of all ids; place: an id's place among the
    ``PAIRED`` most frequent ones, the last place for all others; after (place, place): shares of pairs of these; spare: what
    is left of an id's successors for the overall shares; sums (id, class): one by the sum of the bent distribution;
    one (id): the share that a single successor has."""
    spark = pairs.sparkSession
    kinds = spark.createDataFrame(pa.table({"prev": np.arange(vocabulary), "k": kind.astype(np.int32)}))
    split = pairs.select("lag", F.floor(F.col("pair") / vocabulary).alias("prev"), F.pmod("pair", F.lit(vocabulary)).alias("id"), "n")
    counts = split.where(F.col("lag") == LAG).join(F.broadcast(kinds), "prev").groupBy("id", "k").agg(F.sum("n").alias("n"))
    c = _gathered(counts, (vocabulary, CLASSES), np.float32)  # exact up to 2**24, then to seven digits
    overall = c.sum(axis=1, dtype=np.float64) + 0.05
    overall /= overall.sum()
    after_class = (c.sum(axis=0, dtype=np.float64) + SMOOTH).astype(np.float32)
    c += (SMOOTH * overall[:, None]).astype(np.float32)
    c /= after_class
    theta = c
    place = np.where(row < PAIRED, row, PAIRED)
    shared = spark.sparkContext.broadcast(((theta / overall[:, None]).astype(np.float32), place))
    # an id has no more rows than the vocabulary has ids, and is one of a packed row in the end
    found = split.where("lag = 1").select("prev", "id", "n").repartition("prev").mapInPandas(
        _successors(shared), "prev binary, total binary, kinds binary, bent binary, blocked binary, block binary")
    total, kinds_after = np.zeros(vocabulary), np.ones(vocabulary)  # as much for unseen pairs as there are different ones
    sums, after = np.zeros((vocabulary, CLASSES), np.float32), np.zeros((PAIRED + 1, PAIRED + 1), np.float32)
    for r in found.collect():
        prev, blocked = np.frombuffer(r["prev"], np.int64), np.frombuffer(r["blocked"], np.int64)
        total[prev], kinds_after[prev] = np.frombuffer(r["total"], np.float64), np.frombuffer(r["kinds"], np.int64)
        sums[prev] = np.frombuffer(r["bent"], np.float32).reshape(-1, CLASSES)
        after[place[blocked]] = np.frombuffer(r["block"], np.float32).reshape(-1, PAIRED + 1)
        after[place[blocked]] /= (total[blocked] + kinds_after[blocked])[:, None].astype(np.float32)
    shared.destroy()
    total += kinds_after
    sums += kinds_after[:, None].astype(np.float32)
    sums /= total[:, None].astype(np.float32)
    return (theta, overall.astype(np.float32), place, after, (kinds_after / total).astype(np.float32), 1 / sums, (1 / total).astype(np.float32))


def _successors(shared):
    """Of each id before: all its pairs, the number of different ones, their sum bent by class, and its row of ``after`` in counts."""
    def run(batches):
        ratio, place = shared.value
        total, kinds, bent, blocks = np.zeros(len(ratio)), np.zeros(len(ratio), np.int64), np.zeros(ratio.shape), {}
        for b in batches:
            b = b.sort_values("prev", kind="stable")
            prev, t, n = (b[c].to_numpy() for c in ("prev", "id", "n"))
            if not len(prev):
                continue
            edge = np.flatnonzero(np.concatenate([[True], prev[1:] != prev[:-1]]))
            p = prev[edge]
            total[p] += np.add.reduceat(n, edge)
            kinds[p] += np.diff(np.append(edge, len(prev)))
            bent[p] += np.add.reduceat(ratio[t] * n[:, None].astype(np.float64), edge)
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(prev)]):
                if place[prev[i]] < PAIRED:
                    to = place[t[i:j]]
                    blocks.setdefault(int(prev[i]), np.zeros(PAIRED + 1, np.float32))[to[to < PAIRED]] = n[i:j][to < PAIRED]
        found = np.flatnonzero(kinds)
        for s in range(0, len(found), 1024):
            p = found[s:s + 1024].astype(np.int64)
            blocked = [x for x in p.tolist() if x in blocks]
            yield _row(prev=p, total=total[p], kinds=kinds[p], bent=bent[p].astype(np.float32), blocked=np.array(blocked, np.int64),
                       block=np.array([blocks[x] for x in blocked], np.float32))

    return run


def _chunks(end: int):
    """Documents put together until they have ``CHUNK_IDS`` ids; a chunk's number is its task's and a running one."""
    def run(batches):
        tokens.forget()
        at, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            nonlocal at, size
            k1, k2, ids = zip(*rows)
            lengths = np.array([len(x) for x in ids]) // np.dtype(_narrow(end)).itemsize
            part = pd.DataFrame({"chunk": [at], "k1": [np.array(k1, np.int64).tobytes()], "k2": [np.array(k2, np.int64).tobytes()],
                                 "lengths": [lengths.astype(np.int64).tobytes()], "ids": [b"".join(ids)]})
            at, size = at + 1, 0
            rows.clear()
            return part

        for b in batches:
            for r in b[["k1", "k2", "ids"]].itertuples(index=False, name=None):
                rows.append(r)
                size += len(r[2]) // np.dtype(_narrow(end)).itemsize
                if size >= CHUNK_IDS:
                    yield out()
        if rows:
            yield out()

    return run


def _stream(lengths: bytes, ids: bytes, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's lengths, ids, and pairs as numbers."""
    lengths, ids = np.frombuffer(lengths, np.int64), np.frombuffer(ids, _narrow(end)).astype(np.int64)
    return lengths, ids, ids_before(ids, lengths, end) * (end + 1) + ids


def _wanted(shared, end: int):
    """A chunk's different pairs that ``after`` has not."""
    def run(batches):
        place = shared.value[2][2]
        for b in batches:
            for chunk, lengths, ids in b[["chunk", "lengths", "ids"]].itertuples(index=False, name=None):
                pair = np.unique(_stream(lengths, ids, end)[2])
                pair = pair[(place[pair // (end + 1)] == PAIRED) | (place[pair % (end + 1)] == PAIRED)]
                if len(pair):
                    yield pd.DataFrame({"chunk": chunk, "pair": pair})

    return run


def _score(shared, flat: np.ndarray, end: int):
    """Scores from sorted rows: a chunk's own (pair -1), then its counts of pairs."""
    def run(batches):
        tokens.forget()
        model = Model(*shared.value, Attention(flat))
        head, pairs, counts = None, [], []

        def out():
            k1, k2, lengths, ids = head
            lengths, ids, key = _stream(lengths, ids, end)
            known, n = np.concatenate([*pairs, [1 << 62]]), np.concatenate([*counts, [0]])
            at = np.searchsorted(known, key)
            rare = np.where(known[at] == key, n[at], 0).astype(np.float32)
            return pd.DataFrame({"k1": np.frombuffer(k1, np.int64), "k2": np.frombuffer(k2, np.int64), "score": model.score(ids, lengths, end, rare)})

        for b in batches:
            pair, n = b["pair"].to_numpy(), b["n"].to_numpy()
            heads = np.flatnonzero(pair < 0).tolist()
            for i, j in zip([-1, *heads], [*heads, len(b)]):
                if i >= 0:
                    if head is not None:
                        yield out()
                    head, pairs, counts = tuple(b[c].iloc[i] for c in ("k1", "k2", "lengths", "ids")), [], []
                if j > i + 1:
                    pairs.append(pair[i + 1:j])
                    counts.append(n[i + 1:j])
        if head is not None:
            yield out()

    return run


def _joined(batches):
    for b in batches:
        if len(b):
            yield pd.DataFrame({"words": [b" ".join(map(bytes, b["word"]))], "c": [b["c"].to_numpy().astype(np.int64).tobytes()]})


def _frequent(words: DataFrame, limit: int) -> tuple[bytes, np.ndarray]:
    """At most ``limit`` words, the most frequent ones, joined by spaces (they hold none), and their counts.

    Counts fall into a fixed number of bins; whole bins are taken, so no task and not the driver sorts words."""
    binned = words.where(F.octet_length("word") > 0).withColumn("b", F.floor(16 * F.log2("c")).cast("int"))
    least, taken = None, 0
    for r in sorted(binned.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        taken += r["n"]
        if taken > limit:
            break
        least = r["b"]
    if least is None:
        return b"", np.zeros(0, np.int64)
    got = binned.where(F.col("b") >= least).select("word", "c").mapInPandas(_joined, "words binary, c binary").collect()
    return b" ".join(bytes(r["words"]) for r in got), np.concatenate([np.frombuffer(r["c"], np.int64) for r in got])


_TOP: dict = {}  # one table of frequent words per Python worker: log10 of their counts and one, never 0


def _base(shared):
    """Of each document the words among the most frequent ones, summed, and the others with their numbers."""
    def run(batches):
        if _TOP.get("of") is not shared.value:
            words, counts = shared.value
            _TOP.update({"of": shared.value, "counts": dict(zip(words.split(b" ") if words else [], np.log10(counts + 1.0).tolist()))})
        top = _TOP["counts"]
        for b in batches:
            out = []
            for t in b["text"]:
                ws = text_words(t)
                got = list(map(top.get, ws, repeat(0.0)))
                other = got.count(0.0)
                rare = Counter(filterfalse(top.__contains__, ws)) if other else {}
                out.append((len(ws) + 1, len(ws) - other, float(sum(got)), [{"word": w, "n": c} for w, c in rare.items()]))
            part = pd.DataFrame(out, columns=["n_tokens", "top_known", "top_log", "rare"])
            yield pd.concat([b.drop(columns="text").reset_index(drop=True), part], axis=1).astype({"doc_id": "Int64"})

    return run


def scores(docs: DataFrame, path: str | None = None, top_words: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    with batches_of(docs.sparkSession, BATCH_BYTES):  # whatever Python makes is stored here
        return _scores(docs, path, top_words)


def _scores(docs: DataFrame, path: str | None, top_words: int) -> DataFrame:
    spark = docs.sparkSession
    path = path or tokens.default_path()
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    end = vocabulary - 1  # the vocabulary's own end-of-text id
    # rows that repeat a document have its keys, and its results
    d = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("k2"),
                    F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    encoded = stored(d.select("k1", "k2", "held_out", "text").mapInPandas(
        _encoded(path, end), "k1 long, k2 long, held_out boolean, ids binary"), "ids")
    train = encoded.where("not held_out").select("k1", "ids")
    pairs = stored(train.select("ids").mapInPandas(_pair_counts(vocabulary, end), "lag int, pair long, n long").groupBy("lag", "pair").agg(F.sum("n").alias("n")), "pairs")
    release(spark)
    row, kind = id_classes(pairs, vocabulary)
    shared = spark.sparkContext.broadcast((row, kind, class_probabilities(pairs, kind, row, vocabulary)))
    flat = Attention.start(row, kind).flat
    for part in range(ROUNDS):
        mine = train.where(F.pmod("k1", F.lit(ROUNDS)) == part)  # the others need not reach Python
        flat = _averaged(mine.mapInPandas(_fit(shared, end, flat, part), "weight double, flat binary"), flat)
    chunks = stored(encoded.select("k1", "k2", "ids").mapInPandas(_chunks(end), "chunk long, k1 binary, k2 binary, lengths binary, ids binary"), "chunks")
    discard(encoded)
    # counts beyond those in the broadcast; no chunk asks for a pair twice
    asked = chunks.select("chunk", "lengths", "ids").mapInPandas(_wanted(shared, end), "chunk long, pair long")
    counts = asked.join(pairs.where("lag = 1").select("pair", "n"), "pair").select("chunk", "pair", "n")
    met = chunks.withColumns({"pair": F.lit(-1).cast("long"), "n": F.lit(0).cast("long")}).unionByName(counts, allowMissingColumns=True)
    met = met.repartition(bucket(spark), "chunk").sortWithinPartitions("chunk", "pair")
    scored = met.mapInPandas(_score(shared, flat, end), "k1 long, k2 long, score double")
    scored = stored(scored.dropDuplicates(["k1", "k2"]), "scores")
    shared.destroy()
    discard(chunks)
    discard(pairs)
    release(spark)

    words = d.where("not held_out").select("text").mapInPandas(_word_counts, "word binary, n long")
    words = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    release(spark)
    n, v, ends = words.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.octet_length("word") == 0, F.col("c")))).head()
    n, v, ends = n or 0, v or 0, ends or 0
    frequent = spark.sparkContext.broadcast(_frequent(words, top_words))
    rows = d.mapInPandas(_base(frequent), "k1 long, k2 long, doc_id long, held_out boolean, n_tokens long, top_known long, top_log double, "
                         "rare array<struct<word: binary, n: long>>")
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "base")
    rare = rows.select("rid", F.explode("rare").alias("x")).select("rid", "x.word", F.col("x.n").alias("m"))
    # words that are not so frequent: no key has more than 1 in top_words of all tokens
    met = rare.join(words, "word").groupBy("rid").agg(
        F.sum("m").alias("more_known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("more_log"))
    zero = F.lit(0)
    out = rows.drop("rare").join(met, "rid", "left").join(scored, ["k1", "k2"])
    total = F.log10(F.lit(float(n + v + 1)))
    base = F.col("top_log") + F.coalesce("more_log", F.lit(0.0)) + F.log10(F.lit(float(ends + 1))) - F.col("n_tokens") * total
    return out.select("doc_id", "held_out", "n_tokens", (F.col("top_known") + F.coalesce("more_known", zero) + int(ends > 0)).cast("long").alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
