"""Operator 2: n-gram Jaccard join by a MinHash LSH forest with exact verification.

1. A text's set are the hashes of its runs of ``WORDS`` words (one run of all its words if it has fewer).  Equal texts are
   one node.  Each of ``TREES`` trees holds every node under a signature of ``DEPTH`` least hashes.
2. Tries over the signatures, climbed from the longest prefixes up: nodes are candidates of each other if their signatures in
   some tree share a prefix.  Members of a trie node are tied to its least member, which alone goes up to the next
   shorter prefix, so a trie node meets one row of each child.  Prefixes are shortened until pairs at the
   threshold are found with ``RECALL`` at least, 1 - (1 - threshold ** depth) ** trees; ties make candidate groups.
3. Exact verification: all pairs within a candidate group, none listed.  Groups are cut into blocks of about ``BLOCK``
   nodes and ``BLOCK_BYTES`` of text; each pair of blocks is a row key of its own, and one task counts the shared runs of its nodes
   by matrix products.  It returns a row per node: its number of links, and a node that it is tied to through links.
4. Links of a node add up over its pairs of blocks; ties make the classes.

Result, per document: class_id (the least document id of its class), n_links (other different texts whose similarity
is the threshold or more), n_copies (documents with the same text, itself included).

Cases: null and empty texts have no runs and are copies of each other, without links; whole texts count,
however long; repeated rows are copies; a null id never names a class unless all its ids are null;
similarity at the threshold is a link; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, discard, release, stored
from .components import components, join_unique
from .hashing import PART, Part, mixed
from .tokens import forget

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.999
BLOCK = 2048
BLOCK_BYTES = 4 << 20  # of text
DENSE = 32  # runs in more nodes of a block than this are counted by matrix products

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def matched_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix that finds pairs at the threshold with the recall asked for."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold ** k) ** trees >= recall:
            return k
    return 1


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's number of them.  Words longer than a part count as several."""
    hashes, owner = [], []
    data, marks, place = bytearray(), [], 0

    def flush():
        raw = np.frombuffer(bytes(data), dtype=np.uint8)
        word = ~_SPACE[raw]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            p = Part(bytes(data))
            hashes.append(p.hashes(s, e) ^ mixed((e - s).astype(np.uint64)))
            owner.append(np.array([m[0] for m in marks])[np.searchsorted([m[1] for m in marks], s, side="right") - 1])

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            stop = min(len(t), at + PART - 1)
            if stop < len(t):  # cut behind white space if there is any
                cut = max(t.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                stop = cut + 1 if cut >= at else stop
            if place + stop - at + 1 > PART:
                flush()
                data, marks, place = bytearray(), [], 0
            marks.append((i, place))
            data += t[at:stop] + b" "
            place += stop - at + 1
            at = stop
    if marks:
        flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    return h, np.bincount(o, minlength=len(texts))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted different hashes of the runs of words of each text."""
    h, n = _word_hashes(texts)
    ends = np.cumsum(n)
    if len(h) >= words:
        runs = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            runs = mixed(runs + h[k: k + len(runs)] * np.uint64(2 * k + 3))
    else:
        runs = np.zeros(0, np.uint64)
    out = []
    for s, e in zip((ends - n).tolist(), ends.tolist()):
        if e - s >= words:
            out.append(np.unique(runs[s: e - words + 1]))
        elif e > s:
            one = np.array([e - s], dtype=np.uint64)
            for k in range(s, e):
                one = mixed(one + h[k:k + 1] * np.uint64(5))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return r[:n] | np.uint64(1), r[n:]


def _texts(column) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in column]


def _prefixes(words: int, trees: int, depth: int, matched: int):
    def run(batches):
        forget()
        a, b = _functions(trees * depth)
        for batch in batches:
            keys = []
            for s in shingle_sets(_texts(batch["text"]), words):
                if not len(s):
                    keys.append(None)
                    continue
                least = np.full(trees * depth, ~np.uint64(0))
                for i in range(0, len(s), 4096):
                    least = np.minimum(least, (s[i:i + 4096, None] * a[None, :] + b[None, :]).min(axis=0))
                m = mixed(least).reshape(trees, depth)
                k, levels = np.arange(trees, dtype=np.uint64), []
                for d in range(depth):
                    k = mixed(k * np.uint64(31) + m[:, d])
                    if d + 1 >= matched:
                        levels.append(k.view(np.int64))
                keys.append(np.stack(levels, axis=1).tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": batch["node"], "bytes": batch["bytes"], "prefixes": keys})

    return run


def _ties(signed: DataFrame, levels: int) -> DataFrame:
    """Pairs u, v of nodes under one trie node, from the longest prefixes up; of a child only its least node goes on."""
    rows = signed.where("prefixes IS NOT NULL").groupBy("node").agg(F.first("prefixes").alias("prefixes"))
    rows = rows.select("node", F.explode("prefixes").alias("p"))
    rows = rows.select("node", *[F.get("p", i).alias(f"p{i}") for i in range(levels)])
    ties = []
    for i in reversed(range(levels)):
        rows = stored(rows, "trie")
        above = [F.first(f"p{k}").alias(f"p{k}") for k in range(i)]  # the same for all under a prefix
        tries = rows.groupBy(f"p{i}").agg(F.min("node").alias("least"), F.max("node").alias("most"), *above)
        shared = tries.where("least <> most").select(f"p{i}", "least")
        ties.append(join_unique(rows, shared, f"p{i}", rows.count()).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
        rows = tries.select(F.col("least").alias("node"), *[f"p{k}" for k in range(i)])
    out = ties[0]
    for t in ties[1:]:
        out = out.unionByName(t)
    return out.distinct()


def _sets(words: int):
    def run(batches):
        for b in batches:
            yield b.drop(columns="text").assign(runs=[s.tobytes() for s in shingle_sets(_texts(b["text"]), words)])

    return run


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of hashes that left and right sets share (indices into ``sets``)."""
    sizes = np.array([len(s) for s in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    df = np.bincount(at, minlength=len(every))
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.full((len(left), len(right)), (df == len(sets)).sum(), dtype=np.int32)  # in all of them
    some = (df > 1) & (df < len(sets))
    dense = np.flatnonzero(some & (df > DENSE))
    column = np.full(len(every), -1)
    column[dense] = np.arange(len(dense))
    c = column[at]
    entry = np.flatnonzero(c >= 0)
    entry = entry[np.argsort(c[entry], kind="stable")]
    ce, re = c[entry], row[entry]
    for s in range(0, len(dense), 1024):
        i, j = np.searchsorted(ce, [s, s + 1024])
        m = np.zeros((len(sets), min(1024, len(dense) - s)), dtype=np.float32)
        m[re[i:j], ce[i:j] - s] = 1
        np.add(out, m[left] @ m[right].T, out=out, casting="unsafe")  # whole numbers up to 1024
    rare = np.flatnonzero(some[at] & (df[at] <= DENSE))
    if len(rare):
        rare = rare[np.argsort(at[rare], kind="stable")]
        hash_, r = at[rare], row[rare]
        for gap in range(1, DENSE):  # nodes of a hash stand side by side: pair each with the next, the one after, ...
            i = np.flatnonzero(hash_[gap:] == hash_[:-gap])
            if not len(i):
                break
            for x, y in ((r[i], r[i + gap]), (r[i + gap], r[i])):
                k = (place_l[x] >= 0) & (place_r[y] >= 0)
                np.add.at(out, (place_l[x[k]], place_r[y[k]]), 1)
    return out


def linked(common: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have the threshold or more, from the runs they share and the sizes of their sets, in slabs of rows.

    In float64: the slack covers its rounding, far below the step from one number of shared runs to the next."""
    out = np.empty(common.shape, dtype=bool)
    for s in range(0, len(left), 256):
        both = left[s:s + 256, None].astype(np.float64) + right[None, :]
        out[s:s + 256] = common[s:s + 256].astype(np.float64) * (1 + threshold) >= threshold * both - 1e-6
    return out


def _verify(threshold: float):
    def solve(rows):
        (_, i, j), sets = rows[0][:3], [np.frombuffer(r[5], np.uint64) for r in rows]
        blocks = np.array([r[3] for r in rows])
        size = np.array([len(s) for s in sets], dtype=np.float64)
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        if not len(left) or not len(right):
            return
        link = linked(shared(sets, left, right), size[left], size[right], threshold)
        if i == j:
            np.fill_diagonal(link, False)
            counts = link.sum(axis=1)
        else:
            counts = np.concatenate([link.sum(axis=1), link.sum(axis=0)])
        nodes = left if i == j else np.concatenate([left, right])
        if not counts.any():
            return
        # least index reached through links
        label, n = np.arange(len(nodes), dtype=np.int32), len(left)
        far = np.int32(len(nodes))
        while True:
            new = label.copy()
            for s in range(0, n, 256):  # slabs of rows
                slab = link[s:s + 256]
                to_left = np.where(slab, (label if i == j else label[n:])[None, :], far).min(axis=1)
                new[s:s + len(slab)] = np.minimum(new[s:s + len(slab)], to_left)
                if i != j:
                    new[n:] = np.minimum(new[n:], np.where(slab, new[s:s + len(slab)][:, None], far).min(axis=0))
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        for k in np.flatnonzero(counts):
            yield rows[nodes[k]][4], int(counts[k]), rows[nodes[label[k]]][4]

    def run(batches):
        rows, out = [], []
        for b in batches:
            for r in b[["grp", "i", "j", "block", "node", "runs"]].itertuples(index=False, name=None):
                if rows and rows[-1][:3] != r[:3]:
                    out += solve(rows)
                    rows = []
                if rows and rows[-1][4] == r[4]:
                    continue  # a repeated row's text
                rows.append(r)
            if out:
                yield pd.DataFrame(out, columns=["node", "links", "tied"])
                out = []
        if rows:
            out += solve(rows)
        yield pd.DataFrame(out, columns=["node", "links", "tied"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_copies and node and grp (16-byte keys of the text and of the class) of every document."""
    spark = docs.sparkSession
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    d = docs.select(F.col("doc_id").cast("long"), node.alias("node"), "text")
    matched = matched_depth(trees, depth, threshold, recall)
    signed = stored(d.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInPandas(
        _prefixes(words, trees, depth, matched), "doc_id long, node binary, bytes long, prefixes array<array<long>>"), "prefixes")
    groups = stored(components(_ties(signed, depth - matched + 1)), "groups")
    release(spark)
    copies = stored(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("bytes").alias("bytes")), "copies")
    groups = stored(groups.join(copies.drop("n_copies"), "node"), "groups")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    sizes = groups.groupBy("component").agg(n_blocks.alias("blocks"))
    mine = join_unique(groups, sizes, "component", groups.count())
    mine = mine.select("node", F.col("component").alias("grp"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "first")
    texts = d.join(mine.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))
    sets = stored(texts.select("node", "grp", "blocks", "block", "text").mapInPandas(
        _sets(words), "node binary, grp binary, blocks int, block int, runs binary"), "sets")
    release(spark)
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "runs")
    dealt = pairs.repartition(bucket(spark), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    links = stored(dealt.mapInPandas(_verify(threshold), "node binary, links long, tied binary"), "links")
    discard(sets)
    release(spark)
    found = components(links.select(F.col("node").alias("u"), F.col("tied").alias("v")))
    n = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = copies.join(n, "node", "left").join(found, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    nodes = stored(nodes.drop("bytes"), "nodes")
    least = nodes.groupBy("grp").agg(F.min("first").alias("class_id"))
    nodes = join_unique(nodes, least, "grp", nodes.count())
    nodes = stored(nodes.select("node", "grp", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"), "nodes")
    return join_unique(signed.select("doc_id", "node"), nodes, "node", signed.count())


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of each class the one with the least id; all columns of ``docs``."""
    found = near_duplicates(docs, **options)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("grp").agg(F.min("node").alias("stays"), F.first("class_id").alias("id"))
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    keyed = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("own"), node.alias("node"))
    kept = keyed.join(stay.select("stays", "id"), (F.col("node") == F.col("stays")) & F.col("own").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["node"]).select("document.*")
