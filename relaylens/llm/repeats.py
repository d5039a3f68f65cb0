"""Operator 3: removal of repeated passages by bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else in the corpus.

1. Every string of ``LENGTH`` bytes belongs to one anchor, the ``GRAM``-byte gram of least hash in it
   (leftmost if equal), so equal strings have equal anchors wherever they stand.  Neighbouring strings with the
   same anchor make one snippet: a place's snippets say of each of its strings once which anchor owns it.
2. Snippets are counted by anchor.  Anchors that occur once own no repeated string.  Equal snippets fold into one with its
   count; the texts of different snippets with the same anchor are fetched, one text for each.
3. They are dealt by anchor to tasks, which take them in batches of ``BATCH`` bytes.  A batch's suffixes are
   sorted and give its Burrows-Wheeler transform.  Common prefixes of neighbours in suffix order are derived by
   increasing value: boundaries of value l, extended backward by a character through the transform, give the
   boundaries of value l + 1.  It stops below ``LENGTH``: what no boundary parts shares ``LENGTH`` bytes or more,
   and is repeated if it stands for two places or more.
4. The repeated strings go back to all places of their snippets, and from each document its covered bytes are removed.

An anchor with more than ``CROWD`` different snippets (a frequent phrase in ever new surroundings) would be too
large for a batch: its snippets are cut into pieces of ``SPLIT`` strings, dealt by the bytes that all of these strings
cover, folded if equal, and go the same way as other snippets; equal strings meet there, too.

Cases: null and empty texts have no bytes, nothing is removed; texts are UTF-8 bytes, and a removal may cut a
character (the operator's text drops its rest; counts and hash are of bytes); very long texts are cut into overlapping
parts for step 1 alone; repeated rows are documents of their own, repeats of each other; document ids may repeat or be null;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, discard, release, stored
from .hashing import PART, Part, mixed
from .tokens import forget

LENGTH = 200
GRAM = 24
BATCH = 1_500_000
CROWD = 4000
SPLIT = 16

def snippets(part: Part, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """start, number of strings, anchor and hash of each snippet; ``ends`` are where the texts in the part end."""
    n = len(part.raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    h = mixed((part.sums[gram:] - part.sums[:-gram]) * part.down[: n - gram + 1])
    low = np.uint64(PART * 2 - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have:])
    at = (m & low).astype(np.int64)  # the anchor of the string that starts here
    starts = np.arange(len(at))
    fits = ends[np.searchsorted(ends, starts, side="right")] >= starts + length
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    # a run ends before the next run's start or where strings stop fitting
    stop = np.flatnonzero(np.concatenate([(new | ~fits)[1:], [True]]) & fits)
    count = stop - first + 1
    return first, count, h[at[first]].view(np.int64), part.hashes(first, first + count + length - 1).view(np.int64)


def _parts(texts: list[bytes], length: int):
    """Parts of at most PART bytes: the bytes, and (text, offset in it, offset in the part) of its pieces; a long text's pieces overlap by length - 1."""
    data, pieces, step = bytearray(), [], PART - length + 1
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), step):
            piece = t[s: s + PART]
            if len(piece) < length:
                continue
            if len(data) + len(piece) > PART:
                yield bytes(data), pieces
                data, pieces = bytearray(), []
            pieces.append((i, s, len(data)))
            data += piece
    if pieces:
        yield bytes(data), pieces


def _places(length: int, gram: int):
    def run(batches):
        forget()
        for b in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in b["text"]]
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for data, pieces in _parts(texts, length):
                which, offset, place = (np.array(x, dtype=np.int64) for x in zip(*pieces))
                ends = np.append(place[1:], len(data))
                first, count, anchor, hashed = snippets(Part(data), ends, length, gram)
                if not len(first):
                    continue
                p = np.searchsorted(place, first, side="right") - 1
                doc, pos = which[p], first - place[p] + offset[p]
                # a document's equal snippets fold into one row
                order = np.lexsort((pos, hashed, anchor, doc))
                doc, pos, count, anchor, hashed = doc[order], pos[order], count[order], anchor[order], hashed[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (hashed[1:] != hashed[:-1])]))
                n = np.diff(np.append(new, len(doc)))
                raw = pos.astype("<i8").tobytes()
                yield pd.DataFrame({"k1": k1[doc[new]], "k2": k2[doc[new]], "anchor": anchor[new], "snippet": hashed[new], "strings": count[new].astype("int32"),
                                    "n": n, "at": pos[new], "places": [raw[8 * s: 8 * (s + k)] if k > 1 else None for s, k in zip(new.tolist(), n.tolist())]})

    return run


def _texts(length: int):
    """Texts of the snippets wanted from each document."""
    def run(batches):
        for b in batches:
            out = []
            for text, wanted in zip(b["text"], b["wanted"]):
                t = text.encode()
                for w in wanted:
                    out.append((w["anchor"], w["snippet"], w["strings"], w["n"], t[w["at"]: w["at"] + w["strings"] + length - 1]))
            yield pd.DataFrame(out, columns=["anchor", "snippet", "strings", "n", "bytes"])

    return run


def suffix_order(text: np.ndarray, left: np.ndarray, settle: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks.  ``text``: characters from 1, 0 after each string; ``left``: characters to that 0.

    Every 0 is a character of its own, so suffixes are compared up to it, then by place.  With ``settle`` their
    first ``settle`` characters are enough: suffixes that share them stand together in any order and have one rank."""
    n, step = len(text), 7
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    packed = np.zeros(n, np.int64)
    for k in range(step):
        packed = (packed << 9) | np.where(left >= k, padded[k: n + k], 0)
    order = np.argsort(packed, kind="stable")
    p, short = packed[order], left[order] < step
    new = np.concatenate([[True], (p[1:] != p[:-1]) | short[1:] | short[:-1]])
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    while True:
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)  # places in the order that are not settled
        if not len(at) or (settle is not None and step >= settle):
            return order, rank
        own = order[at]
        key = (rank[own] << 32) | rank[own + step]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        # a group's first place keeps the group's rank
        rank[own] = np.maximum.accumulate(np.where(new[at], at, 0))
        step *= 2


def long_prefixes(text: np.ndarray, left: np.ndarray, length: int, settle: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each place whether a boundary of a value below ``length`` parts it from the place before.

    ``settle`` as in ``suffix_order``, ``length`` at least: a rank is then the first place of its group, and no
    boundary below ``length`` lies inside a group."""
    order, rank = suffix_order(text, left, settle)
    n = len(order)
    before = np.where(order > 0, text[order - 1], 0)  # the transform
    back = np.where(before > 0, rank[order - 1], -1)  # where the suffix longer by that character stands
    first = text[order]
    found = np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] == 0)])
    # places whose suffixes' tails are neighbours follow their tails; the others wait for any boundary between the tails
    tail = np.where(first > 0, rank[np.minimum(order + 1, n - 1)], 0)
    open_ = np.flatnonzero(~found)
    exact = order[tail] == order + 1  # not just the tail's group
    apart = (tail[open_ - 1] + 1 != tail[open_]) | ~exact[open_ - 1] | ~exact[open_]
    wait = open_[apart]
    wait = wait[tail[wait] > tail[wait - 1]]  # inside a group of settled suffixes there is no boundary
    lo, hi = tail[wait - 1], tail[wait]
    same = np.concatenate([[False], (before[1:] == before[:-1]) & (before[1:] > 0)])
    frontier = np.flatnonzero(found)
    for _ in range(1, length):
        if not len(frontier):
            break
        # backward extension of the boundaries whose two sides have the same character before them
        reached = back[frontier[same[frontier]]]
        if len(wait):
            if len(wait) * 8 > n or len(frontier) * 8 > n:
                flag = np.zeros(n, np.int32)
                flag[frontier] = 1
                upto = np.cumsum(flag)
                hit = upto[hi] > upto[lo]
            else:
                hit = np.searchsorted(frontier, hi, side="right") > np.searchsorted(frontier, lo, side="right")
            reached = np.concatenate([reached, wait[hit]])
            wait, lo, hi = wait[~hit], lo[~hit], hi[~hit]
        reached = reached[~found[reached]]
        found[reached] = True
        frontier = np.sort(reached)
    return order, found


def _repeated(length: int):
    """Snippets with the runs of their repeated strings, as pairs of first and number."""
    def solve(rows):
        size = np.array([len(r[4]) for r in rows])
        data = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", dtype=np.uint8)
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        text = data.astype(np.int16) + 1
        text[ends] = 0
        left = np.repeat(ends, size + 1) - np.arange(len(text))
        order, parted = long_prefixes(text, left, length, length)
        group = np.cumsum(parted) - 1
        row = np.searchsorted(ends, order)
        strings = np.array([r[2] for r in rows])
        counts = np.array([r[3] for r in rows])
        owned = order - starts[row] < strings[row]
        total = np.bincount(group[owned], counts[row[owned]], minlength=group[-1] + 1)
        at = np.sort(order[owned & (total[group] >= 2)])
        if not len(at):
            return
        first = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = at[first]
        many = np.diff(np.append(np.flatnonzero(first), len(at)))
        r = np.searchsorted(ends, run)
        out = pd.DataFrame({"r": r, "first": run - starts[r], "many": many})
        for i, g in out.groupby("r"):
            yield rows[i][0], rows[i][1], np.stack([g["first"], g["many"]], axis=1).astype("<i4").tobytes()

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for r in b[["anchor", "snippet", "strings", "n", "bytes"]].itertuples(index=False, name=None):
                if rows and rows[-1][:2] == r[:2]:
                    continue
                # batches part where the anchor changes
                if size >= BATCH and rows[-1][0] != r[0]:
                    yield pd.DataFrame(list(solve(rows)), columns=["anchor", "snippet", "runs"])
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) + 1
        if rows:
            yield pd.DataFrame(list(solve(rows)), columns=["anchor", "snippet", "runs"])

    return run


def _anchor_at(data: bytes, anchor: int, gram: int) -> int:
    """The place in a snippet of the gram that all its strings have as their anchor."""
    p = Part(data)
    i = np.arange(len(data) - gram + 1)
    return int(np.argmax(mixed((p.sums[i + gram] - p.sums[i]) * p.down[i]).view(np.int64) == anchor))


def _pieces(length: int, gram: int):
    """Pieces of crowded anchors' snippets, at most ``SPLIT`` strings each, under an anchor of their own.

    Equal strings have their anchor at the same place: those that have it at neighbouring places, a block, also
    have all bytes in common that every string of the block covers.  These bytes name the new anchor."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                at = _anchor_at(r.bytes, r.anchor, gram)
                last = -1
                for block in range(at // SPLIT, -1, -1):
                    # strings that start SPLIT * block to SPLIT * block + SPLIT - 1 before the anchor
                    first, stop = max(last + 1, 0), min(at - SPLIT * block, r.strings - 1)
                    if stop < first:
                        continue
                    last = stop
                    core = r.bytes[at - SPLIT * block: at - SPLIT * block - SPLIT + 1 + length]
                    piece = r.bytes[first: stop + length]
                    key, name = hashlib.blake2b(core, digest_size=8, salt=block.to_bytes(16, "little"), key=(r.anchor & (1 << 64) - 1).to_bytes(8, "little")), hashlib.blake2b(piece, digest_size=8)
                    out.append((r.anchor, r.snippet, first, r.n, *(int.from_bytes(x.digest(), "little", signed=True) for x in (key, name)), stop - first + 1, piece))
            yield pd.DataFrame(out, columns=["anchor", "snippet", "first", "n", "key", "piece", "strings", "bytes"])

    return run


def _joined(batches):
    """Runs of a snippet from those of its pieces."""
    for b in batches:
        runs = []
        for pieces in b["pieces"]:
            each = [np.frombuffer(p["runs"], "<i4").reshape(-1, 2) + np.array([p["first"], 0], "<i4") for p in pieces]
            runs.append(np.concatenate(each).astype("<i4").tobytes())
        yield pd.DataFrame({"anchor": b["anchor"], "snippet": b["snippet"], "runs": runs})


def _cut(text: str | None, found, length: int) -> tuple[bytes, bytes, int]:
    """The bytes of a text, those kept, and the number of maximal removed runs."""
    t = text.encode() if isinstance(text, str) else b""
    if found is None or not len(found):
        return t, t, 0
    marks = np.zeros(len(t) + 1, np.int64)
    for x in found:
        places = np.array([x["at"]]) if x["places"] is None else np.frombuffer(x["places"], "<i8")
        # a snippet that repeats as a whole has no runs of its own
        runs = np.array([[0, x["strings"]]]) if x["runs"] is None else np.frombuffer(x["runs"], "<i4").reshape(-1, 2)
        s = (places[:, None] + runs[None, :, 0]).ravel()
        np.add.at(marks, s, 1)
        np.add.at(marks, s + np.tile(runs[:, 1], len(places)) + length - 1, -1)
    gone = np.cumsum(marks[:-1]) > 0
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return t, np.frombuffer(t, np.uint8)[~gone].tobytes(), spans


def _report(length: int):
    def run(batches):
        for b in batches:
            out = []
            for doc, text, found in zip(b["doc_id"], b["text"], b["found"]):
                t, kept, spans = _cut(text, found, length)
                out.append((doc, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return run


def _rewrite(length: int, text: str):
    def run(batches):
        for b in batches:
            kept = [None if not isinstance(t, str) else _cut(t, f, length)[1].decode("utf-8", "ignore") for t, f in zip(b[text], b["found"])]
            yield b.drop(columns="found").assign(**{text: kept})

    return run


def find_repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``keyed``: k1, k2 (one pair per different row) and text.  Returns k1, k2 and found: the places of snippets with repeated strings."""
    spark = keyed.sparkSession
    parts = bucket(spark)
    places = stored(keyed.mapInPandas(_places(length, gram), "k1 long, k2 long, anchor long, snippet long, strings int, n long, at long, places binary"), "places")
    release(spark)
    often = places.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    mine = stored(places.join(often, "anchor"), "repeated-anchors")
    discard(places)
    release(spark)
    one = mine.groupBy("anchor", "snippet").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("from"), F.first("strings").alias("strings"))
    one = stored(one, "snippets")
    kinds = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    differ = one.join(kinds, "anchor")
    wanted = differ.groupBy("from.k1", "from.k2").agg(F.collect_list(F.struct("anchor", "snippet", "strings", "n", F.col("from.at").alias("at"))).alias("wanted"))
    texts = keyed.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInPandas(
        _texts(length), "anchor long, snippet long, strings int, n long, bytes binary")
    texts = stored(texts, "texts")  # rows that repeat a document give a snippet's text again
    release(spark)
    crowds = kinds.where(F.col("kinds") > CROWD).select("anchor")
    sorted_ = texts.join(crowds, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor", "snippet")
    runs = sorted_.mapInPandas(_repeated(length), "anchor long, snippet long, runs binary")
    crowd = texts.join(crowds, "anchor", "left_semi").dropDuplicates(["anchor", "snippet"]).mapInPandas(
        _pieces(length, gram), "anchor long, snippet long, first int, n long, key long, piece long, strings int, bytes binary")
    crowd = stored(crowd, "pieces")
    folded = crowd.groupBy(F.col("key").alias("anchor"), F.col("piece").alias("snippet")).agg(
        F.first("strings").alias("strings"), F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    folded = folded.select("anchor", "snippet", "strings", "n", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "snippet")
    again = folded.mapInPandas(_repeated(length), "anchor long, snippet long, runs binary").toDF("key", "piece", "runs")
    crowd = crowd.select("anchor", "snippet", "first", "key", "piece").join(again, ["key", "piece"]).groupBy("anchor", "snippet").agg(
        F.collect_list(F.struct("first", "runs")).alias("pieces")).mapInPandas(_joined, "anchor long, snippet long, runs binary")
    runs = stored(runs.unionByName(crowd), "runs")
    release(spark)
    # a snippet in two places or more repeats as a whole, whatever the others have
    whole = one.where("n > 1").select("anchor", "snippet", F.lit(None).cast("binary").alias("runs"))
    some = runs.join(one.where("n > 1"), ["anchor", "snippet"], "left_anti")
    found = mine.join(whole.unionByName(some), ["anchor", "snippet"])
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "places", "strings", "runs")).alias("found"))


def _keys():
    return F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(3), "text", "doc_id").alias("k2")


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    keyed = docs.select(*_keys(), F.col("doc_id").cast("long"), "text")
    found = find_repeats(keyed, length, gram)
    return keyed.join(found, ["k1", "k2"], "left").drop("k1", "k2").mapInPandas(
        _report(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with what is left of their texts; all columns of ``docs``."""
    found = find_repeats(docs.select(*_keys(), "text"), length, gram)
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.select(*_keys(), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    schema = ", ".join(f"{n} {whole.schema[n].dataType.simpleString()}" for n in names)
    out = whole.join(found, ["k1", "k2"], "left").select(*names, "found").mapInPandas(_rewrite(length, names[docs.columns.index("text")]), schema)
    return out.toDF(*docs.columns)
