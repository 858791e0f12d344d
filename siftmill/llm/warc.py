"""WARC records in seekable Zstandard bundles.

A bundle holds the records of one range of page_id as independent Zstandard frames of
``FRAME`` records each (fewer where they would exceed ``FRAME_BYTES``), followed by a
seek table in a skippable frame (sizes of all
frames, number of frames, magic), as the public seekable format has it: any Zstandard
tool can read the whole, and a reader that knows frame and offset opens one frame only.
The index maps record identifiers to (bundle, frame, offset within the frame, length).

Bundles are written to the shared folder under names of the task's attempt; the index
is cut there too, so what it names was written by tasks that succeeded.

Defined results: a record has page_id, url and html as they were, nulls too (marked in a
header); rows that repeat are records of their own at offsets of their own, with the same
identifier. Order in a bundle: page_id, identifier. A null page_id belongs to bundle -1
like the ids from -BUNDLE to -1, and comes first. A bundle with more than ``LARGE`` times
BUNDLE records (null or repeated page_ids) is several files, each in that order. Tasks
write and read frame by frame and hold one at a time. Addresses with control characters are
stored in base64. A page of any length that Spark holds is one record. An empty table writes nothing.
Other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import chunks, cut, fresh

#: page_ids in a bundle, records in a frame, bytes after which a frame ends before that, times BUNDLE that make a bundle too large for one file.
BUNDLE, FRAME, FRAME_BYTES, LARGE = 2048, 64, 1 << 28, 4
#: Bytes of records that a task reads back.
TASK_BYTES = 1 << 27
#: Too large bundles of which the list may be broadcast; more are joined by shuffling.
BROADCAST_BUNDLES = 50_000
DATE = "2000-01-01T00:00:00Z"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(record_id: str, page_id: int | None, url: str | None, html: str | None) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{record_id}>\r\nWARC-Date: {DATE}\r\n"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}\r\n")
    if url is not None:
        plain = url == url.strip() and not any(ord(c) < 32 or ord(c) == 127 for c in url)
        head.append(f"WARC-Target-URI: {url}\r\n" if plain else f"X-Target-URI-Base64: {base64.b64encode(url.encode()).decode()}\r\n")
    if html is None:
        head.append("X-Null: html\r\n")
    body = (html or "").encode()
    return "".join(head).encode() + b"Content-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[str, int | None, str | None, bytes | None]:
    """(record_id, page_id, url, payload) of a record."""
    at = raw.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in raw[:at].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    url = head.get("WARC-Target-URI")
    if url is None and "X-Target-URI-Base64" in head:
        url = base64.b64decode(head["X-Target-URI-Base64"]).decode()
    return head["WARC-Record-ID"][10:-1], int(head["X-Page-ID"]) if "X-Page-ID" in head else None, url, None if "X-Null" in head else raw[at + 4 : at + 4 + size]


def seal(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with the (compressed, plain) sizes of the frames."""
    table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of the frames of a bundle, read from its end."""
    end = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
    if magic != _SEEKABLE or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    table = f.read_at(each * n, end - 9 - each * n)
    out, start = [], 0
    for i in range(n):
        size, plain = struct.unpack("<II", table[each * i : each * i + 8])
        out.append((start, size, plain))
        start += size
    return out


_INDEX = "record_id string, page_id long, bundle long, path string, frame long, offset long, length long"
_KINDS = {"string": pa.string(), "long": pa.int64()}


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple]:
    for batch in chunks(batches, text):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pack(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bundle, part, record_id, page_id, url, html) to bundles; no more than a frame is held."""
    packer = zstandard.ZstdCompressor(level=3)
    for (bundle, _), rows in groupby(_rows(batches, "html"), key=lambda r: r[:2]):
        with files.writer(folder, f"bundle-{bundle}", ".warc.zst") as (path, out):
            frames: list[tuple[int, int]] = []
            plain, index, size = [], [], 0

            def close() -> pa.RecordBatch:
                raw = packer.compress(b"".join(plain))
                out.write(raw)
                frames.append((len(raw), size))
                return _table(index, _INDEX)

            for row in rows:
                raw = record(*row[2:])
                if plain and (len(plain) == FRAME or size + len(raw) > most):
                    yield close()
                    plain, index, size = [], [], 0
                index.append((row[2], row[3], bundle, path, len(frames), size, len(raw)))
                plain.append(raw)
                size += len(raw)
            yield close()
            out.write(seal(frames))


_ID = "lower(md5(concat_ws('|', coalesce(cast(page_id as string), ''), coalesce(url, ''), md5(coalesce(html, '')))))"


def write(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as bundles to the folder; returns the index."""
    spark = pages.sparkSession
    folder = folder or fresh(spark, "warc")
    bundle = F.coalesce(F.floor(F.col("page_id").cast("long") / BUNDLE), F.lit(-1)).cast("long")
    # bundles that repeated or null page_ids make much larger than BUNDLE are dealt to parts
    large = pages.groupBy(bundle.alias("bundle")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE * BUNDLE).select("bundle", F.ceil(F.col("n") / BUNDLE).alias("parts"))
    large = cut(large)
    large = F.broadcast(large) if large.count() <= BROADCAST_BUNDLES else large
    hexed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", bundle.alias("bundle"), F.spark_partition_id().alias("from")).withColumn("m", F.expr(_ID))
    named = hexed.withColumn("record_id", F.concat_ws("-", *[F.substring("m", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])).drop("m")
    dealt = named.join(large, "bundle", "left").withColumn("part", F.pmod(F.xxhash64("record_id") + F.col("from"), F.coalesce("parts", F.lit(1).cast("long"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.select("bundle", "part", "record_id", "page_id", "url", "html").repartitionById(parts, F.pmod(F.col("bundle") + F.col("part"), F.lit(parts)).cast("int")).sortWithinPartitions("bundle", "part", F.asc_nulls_first("page_id"), "record_id")
    return cut(placed.mapInArrow(lambda it: _pack(it, folder, frame_bytes), _INDEX))


_RECORD = "page_id long, url string, record_id string, bundle long, frame long, offset long, length long, html string"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, bundle, frame, offset, length) to records; no more than a frame is held."""
    opener = zstandard.ZstdDecompressor()
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for path, wanted in groupby(rows, key=lambda r: r[0]):
        with files.opened(path) as f:
            frames = seek_table(f)
            for number, inside in groupby(wanted, key=lambda r: r[2]):
                start, size, full = frames[number]
                plain = opener.decompress(f.read_at(size, start), max_output_size=max(full, 1))
                out = []
                for _, bundle, frame, offset, length in inside:
                    record_id, page_id, url, html = parse(plain[offset : offset + length])
                    out.append((page_id, url, record_id, bundle, frame, offset, length, None if html is None else html.decode()))
                yield _table(out, _RECORD)


def read(index: DataFrame) -> DataFrame:
    """The records that the index names, read back from their bundles; a frame is opened once.

    The index is small beside what it stands for, so the number of tasks follows the bytes of the records.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    placed = index.select("path", "bundle", "frame", "offset", "length").repartition(tasks, "path", "frame").sortWithinPartitions("path", "frame", "offset")
    return placed.mapInArrow(_unpack, _RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle all pages and read every record back through the index: where it lies and what came back."""
    back = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return back.select("page_id", "url", "record_id", "bundle", "frame", "offset", "length", F.octet_length("html").cast("long").alias("payload_bytes"), F.md5("html").alias("payload_md5"))


_FIXED = len(record("0" * 36, 0, "", "")) - 2

SQL = f"""
WITH named AS (SELECT page_id, url, md5(page_id || '|' || url || '|' || md5(html)) AS m, strlen(html) AS payload_bytes, md5(html) AS payload_md5 FROM pages),
sized AS (SELECT page_id, url, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS record_id,
    CAST(floor(page_id / {BUNDLE}) AS BIGINT) AS bundle, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_md5,
    CAST({_FIXED} + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(CAST(payload_bytes AS VARCHAR)) + payload_bytes AS BIGINT) AS length FROM named),
framed AS (SELECT *, (row_number() OVER (PARTITION BY bundle ORDER BY page_id, record_id) - 1) // {FRAME} AS frame FROM sized)
SELECT page_id, url, record_id, bundle, frame, CAST(coalesce(sum(length) OVER (PARTITION BY bundle, frame ORDER BY page_id, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    length, payload_bytes, payload_md5 FROM framed"""
