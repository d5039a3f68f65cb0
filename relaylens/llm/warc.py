"""Operator 8: web archives in ZIP packages, written and read back by range reads.

Writing: each task packs its pages into ZIP archives with two stored members, ``archive/data.warc.gz`` (a
gzip member per record) and ``indexes/index.cdxj`` (a line per record: offset and length).  A page whose
payload (the html in UTF-8) has been seen at a smaller page id becomes a revisit record that refers to it.
Archives go to the shared folder under names that no other attempt uses; those of finished tasks
are listed in a stored table, and only they are read.

Reading: from an archive's tail the end record, its ZIP64 form if there is one and the central directory
are parsed; local headers give the place of the members' data; the index is read and dealt out in
blocks, and each block's records are read by range from inside the stored member.  Nothing is extracted.

Cases: null html is an empty payload; null urls are empty; a null page id is kept as null and is always a
response, and so is a row that repeats the smallest page id of its payload; with ``min_bytes``, smaller
payloads are always responses; very long pages are one record; an empty table writes no archive and gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, scratch_path, stored

ARCHIVE_BYTES = 32 << 20
READ_RECORDS = 256
BROADCAST_ROWS = 500_000  # of (digest, page id), about 50 MB in memory
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, bytes long, records long"


def _file_system(path: str):
    """The file system of a folder that all machines share, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone."""
    name = "null-" + uuid.uuid4().hex if page_id is None else str(page_id)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>",
              f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, archive_bytes: int):
    def write(data: bytearray, index: list[str]):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(DATA, bytes(data))
            z.writestr(INDEX, "\n".join(index))
        fs, path = _file_system(f"{folder}/{uuid.uuid4().hex}.wacz")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(out.getbuffer())
        return pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "bytes": [out.tell()], "records": [len(index)]})

    def run(batches):
        data, index = bytearray(), []
        for b in batches:
            for page, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"]):
                page = None if pd.isna(page) else int(page)
                payload = html.encode() if isinstance(html, str) else b""
                z = _gzip(record(page, url if isinstance(url, str) else "", payload, None if pd.isna(refers) else int(refers)))
                index.append(json.dumps({"offset": len(data), "length": len(z)}))
                data += z
                if len(data) >= archive_bytes:
                    yield write(data, index)
                    data, index = bytearray(), []
        if index:
            yield write(data, index)

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, html to archives in ``folder``; returns the stored list of archives."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html")
    p = p.withColumn("sha1", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    big = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_bytes
    first = p.where(big & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").select(F.col("sha1").alias("seen"), "first"), "payloads")
    few = first.count() <= BROADCAST_ROWS
    p = p.join(F.broadcast(first) if few else first, (F.col("sha1") == F.col("seen")) & big, "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    p = p.select("page_id", "url", "html", refers.alias("refers_to"))
    return stored(p.mapInPandas(_writer(folder, archive_bytes), MANIFEST), "manifest")


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, offset of the data, bytes) from a ZIP's directories; ``read(offset, n)`` reads a range."""
    tail = min(size, 65_557)  # the end record and the longest comment
    data = read(size - tail, tail)
    end = data.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, start = struct.unpack("<HII", data[end + 10:end + 20])
    at = size - tail + end
    if at >= 20 and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        sign, _, where, _ = struct.unpack("<4sIQI", read(at - 20, 20))
        if sign == b"PK\x06\x07":
            z = read(where, 56)
            if z[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is not where its locator says")
            count, length, start = struct.unpack("<QQQ", z[32:56])
    central, out, i = read(start, length), {}, 0
    for _ in range(count):
        if central[i:i + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", central[i + 10:i + 12])
        packed, full, n, m, k = struct.unpack("<IIHHH", central[i + 20:i + 34])
        offset, = struct.unpack("<I", central[i + 42:i + 46])
        name = central[i + 46:i + 46 + n].decode()
        extra = central[i + 46 + n:i + 46 + n + m]
        while len(extra) >= 4:  # the ZIP64 field has those of the three that don't fit, in this order
            kind, long = struct.unpack("<HH", extra[:4])
            if kind == 1:
                body = extra[4:4 + long]
                if full == 0xFFFFFFFF:
                    full, body = struct.unpack("<Q", body[:8])[0], body[8:]
                if packed == 0xFFFFFFFF:
                    packed, body = struct.unpack("<Q", body[:8])[0], body[8:]
                if offset == 0xFFFFFFFF:
                    offset, body = struct.unpack("<Q", body[:8])[0], body[8:]
            extra = extra[4 + long:]
        local = read(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        a, b = struct.unpack("<HH", local[26:30])
        out[name] = (method, offset + 30 + a + b, packed)
        i += 46 + n + m + k
    return out


def _open(path: str):
    fs, p = _file_system(path)
    f = fs.open_input_file(p)

    def read(offset: int, n: int) -> bytes:
        f.seek(offset)
        got = f.read(n)
        if len(got) != n:
            raise ValueError(f"{path} ends before {offset + n}")
        return got

    return f, read


def _blocks(batches):
    """Blocks of neighbouring records: path, offset, and the records' lengths."""
    for b in batches:
        for path in b["path"]:
            f, read = _open(path)
            with f:
                found = members(read, f.size())
                for name in (DATA, INDEX):
                    if found[name][0] != 0:
                        raise ValueError(f"{path}: {name} is not stored")
                _, base, _ = found[DATA]
                lines = read(*found[INDEX][1:]).decode().split("\n")
            for s in range(0, len(lines), READ_RECORDS):
                part = [json.loads(x) for x in lines[s:s + READ_RECORDS]]
                yield pd.DataFrame({"path": [path], "offset": [base + part[0]["offset"]], "lengths": [[x["length"] for x in part]]})


def parse(data: bytes) -> dict:
    """A record's fields, its HTTP head's and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    fields["payload"] = payload
    return fields


def _records(batches):
    page = lambda uri: int(uri[12:-1]) if uri and not uri.startswith("<urn:x-page:null-") else None
    for b in batches:
        for path, offset, lengths in zip(b["path"], b["offset"], b["lengths"]):
            f, read = _open(path)
            with f:
                data, rows, at = read(int(offset), int(sum(lengths))), [], 0
            for n in lengths:
                r = parse(zlib.decompress(data[at:at + int(n)], 31))
                at += int(n)
                sha1 = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["WARC-Type"] == "response" and digest(r["payload"]) != sha1:
                    raise ValueError(f"{path}: a payload does not fit its digest")
                rows.append((page(r["WARC-Record-ID"]), r["WARC-Target-URI"], int(r["http"]["Content-Length"]), sha1, r["WARC-Type"],
                             page(r.get("WARC-Refers-To")), r["payload"] if r["WARC-Type"] == "response" else None))
            yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype(
                {"page_id": "Int64", "refers_to": "Int64"})


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives listed in the column ``path``, with payloads."""
    spark = archives.sparkSession
    n = max(1, min(bucket(spark), archives.count()))
    blocks = stored(archives.select("path").repartition(n).mapInPandas(_blocks, "path string, offset long, lengths array<long>"), "blocks")
    return blocks.repartition(bucket(spark)).mapInPandas(
        _records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, scratch_path(spark, "archives"))).drop("payload")


def oracle_sql() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, coalesce(url, '') AS url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
q AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::BIGINT) AS fives FROM d)
SELECT page_id, url, payload_bytes,
    array_to_string(list_transform(fives, lambda n: '{letters}'[(n >> 15) + 1] || '{letters}'[((n >> 10) & 31) + 1] || '{letters}'[((n >> 5) & 31) + 1] || '{letters}'[(n & 31) + 1]), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""
