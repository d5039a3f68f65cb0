"""Operator 6: best-fit packing of token sequences by hierarchical residual packing.

A document's ids are its text's ids and one end id.  Documents longer than ``capacity`` are cut into
pieces of that length; other pieces are whole documents.  Pieces of full length are sequences of their
own.  The others are dealt to partitions of about ``TASK_ITEMS``; each packs its items best-fit (longest
first, into the fullest bin that holds it).  Bins that lack at most ``NEARLY`` tokens are done; the others
go to the next round as items, in fewer partitions, and so on as a tree, until one partition is left or a round
leaves more than nine tenths of its items (they don't fit together: nothing is gained by going on).

A bin is one row: its length and its members as packed records, at most ``capacity`` of them.

Cases: null and empty texts have the end id alone; documents may repeat and ids be null, each row is
packed; longer texts are cut, never shortened; ties go to any bin of the same room; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stored

CAPACITY = 2048
TASK_ITEMS = 50_000
NEARLY = 8
FAN_IN = 8
PIECE = np.dtype([("doc", "<i8"), ("known", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = path or tokens.default_path()

    def cut(batches):
        enc, end = tokens.encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = enc.encode(text if isinstance(text, str) else None) + end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s: 4 * (s + capacity)]
                    rows.append((doc, k, s, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of items.  ``rooms`` has a bit for every room that some bin has."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(k)
        if room > n:
            rooms |= 1 << (room - n)
    return bins


def _pack_round(capacity: int):
    def run(batches):
        tokens.forget()  # the texts are encoded
        got = [b for b in batches if len(b)]
        if not got:
            return
        b = pd.concat(got, ignore_index=True)
        lengths, members = b["length"].to_numpy(), b["members"].tolist()
        for s in range(0, len(bins := best_fit(lengths, capacity)), 10_000):
            part = bins[s:s + 10_000]
            yield pd.DataFrame({"length": [int(lengths[x].sum()) for x in part],
                                "members": [b"".join(members[i] for i in x) for x in part]})

    return run


def _as_items(batches):
    for b in batches:
        r = np.zeros(len(b), dtype=PIECE)
        known = b["doc_id"].notna().to_numpy()
        r["doc"], r["known"] = b["doc_id"].fillna(0).to_numpy(dtype="int64"), known
        r["piece"], r["start"], r["length"], r["crc"] = b["piece"], b["start"], b["length"], b["ids_crc32"]
        yield pd.DataFrame({"length": b["length"], "members": [x.tobytes() for x in r]})


def _members(batches):
    for b in batches:
        if not len(b):
            continue
        rs = [np.frombuffer(m, dtype=PIECE) for m in b["members"]]
        r = np.concatenate(rs)
        out = pd.DataFrame({"doc_id": pd.array(r["doc"], dtype="Int64"), "piece": r["piece"], "start": r["start"],
                            "length": r["length"].astype("int64"), "ids_crc32": r["crc"].astype("int64"),
                            "sequence_id": np.repeat(b["sequence_id"].to_numpy(), [len(x) for x in rs]),
                            "offset": np.concatenate([np.cumsum(x["length"], dtype="int64") - x["length"] for x in rs])})
        out.loc[~r["known"], "doc_id"] = pd.NA
        yield out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = stored(pieces(docs, path, capacity, end_id), "pieces")
    items = cut.where(F.col("length") < capacity).mapInPandas(_as_items, "length long, members binary")
    left, done = cut.where(F.col("length") < capacity).count(), []
    parts = max(1, -(-left // TASK_ITEMS))
    while left:
        bins = stored(items.repartition(parts).mapInPandas(_pack_round(capacity), "length long, members binary"), "bins")
        open_ = bins.where(F.col("length") < capacity - NEARLY)
        n = open_.count()
        if parts == 1 or n > 0.9 * left:
            done.append(bins)
            break
        done.append(bins.where(F.col("length") >= capacity - NEARLY))
        items, left, parts = open_, n, max(-(-n // TASK_ITEMS), -(-parts // FAN_IN))
    out = cut.where(F.col("length") >= capacity).mapInPandas(_as_items, "length long, members binary")
    for d in done:
        out = out.unionByName(d)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).mapInPandas(
        _members, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
