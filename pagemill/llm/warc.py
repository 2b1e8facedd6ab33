"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records,
followed by a seek table in a skippable frame (the public seekable format:
compressed and decompressed size of each frame). The index maps a record id to
(bundle, frame, offset within the decompressed frame, length); a reader fetches
and decompresses the frames it needs only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import tidy
from pagemill.llm.spark import cut, removed_at_end, shared_folder
from pagemill.llm.suffix_dedup import ddl

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
RESPONSE, REVISIT = "response", "revisit"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame_start", pa.int64()), ("frame_size", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def record_id(page_id: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record with the page's HTTP response, or a revisit without its body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = "" if url is None else "".join(c for c in url if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {clean}"] * (url is not None)
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Page-Id: {page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record: headers, HTTP headers' declared length, body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "declared": declared, "body": body}


class BundleWriter:
    """Frames of whole records and, at the end, the seek table."""

    def __init__(self, sink, frame_bytes: int, level: int = 3):
        self.sink, self.frame_bytes, self.packer = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.held = self.position = 0

    def add(self, raw: bytes) -> int:
        """The record's offset in the frame being filled."""
        self.pending.append(raw)
        self.held += len(raw)
        return self.held - len(raw)

    def full(self) -> bool:
        return self.held >= self.frame_bytes

    def flush(self) -> tuple[int, int]:
        """Write the frame; its (start, size) in the file."""
        data = b"".join(self.pending)
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.sizes.append((len(packed), len(data)))
        at, self.position = self.position, self.position + len(packed)
        self.pending, self.held = [], 0
        return at, len(packed)

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    each = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * each)
    rows, at = source.read(count * each), 0
    out = []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", rows, i * each)
        out.append((at, packed, plain))
        at += packed
    return out


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        stem = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        number, sink, writer, name = 0, None, None, ""
        waiting: list[tuple[int, int, int]] = []

        def flush():
            start, size = writer.flush()
            rows = [(p, record_id(p), name, start, size, o, n) for p, o, n in waiting]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)

        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                if sink is None:
                    name = f"{stem}-{number:04d}.warc.zst"
                    number += 1
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                page, refers = col["page_id"][i].as_py(), col["refers_to"][i].as_py()
                raw = record(page, col["url"][i].as_py(), (col["html"][i].as_py() or "").encode(), refers, "2024-01-01T00:00:00Z")
                waiting.append((page, writer.add(raw), len(raw)))
                if writer.full():
                    yield flush()
                    if writer.position >= bundle_bytes:
                        writer.close()
                        sink.close()
                        sink = None
        if sink is not None:
            if waiting:
                yield flush()
            writer.close()
            sink.close()

    return run


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        bundle = source = frame = None
        data, frames = b"", {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict = {f.name: [] for f in _RECORD}
            for row in b.to_pylist():
                if row["bundle"] != bundle:
                    bundle, frame = row["bundle"], None
                    source = fs.open_input_file(f"{base}/{bundle}")
                    frames = {start: (packed, plain) for start, packed, plain in seek_table(source)}
                if row["frame_start"] != frame:
                    frame = row["frame_start"]
                    packed, plain = frames[frame]
                    source.seek(frame)
                    data = unpack.decompress(source.read(packed), max_output_size=plain)
                got = parse(data[row["offset"] : row["offset"] + row["length"]])
                f = got["fields"]
                named = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Record-ID"] != f"<{row['record_id']}>" or f["WARC-Type"] == RESPONSE and (digest(got["body"]) != named or len(got["body"]) != got["declared"]):
                    raise ValueError(f"record {row['record_id']} of {bundle} is damaged")
                out["page_id"].append(int(f["X-Page-Id"]))
                out["payload_bytes"].append(got["declared"])
                out["payload_digest"].append(named)
                out["record_type"].append(f["WARC-Type"])
                out["refers_to"].append(int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None)
                out["url"].append(f.get("WARC-Target-URI"))
                out["payload"].append(got["body"] if f["WARC-Type"] == RESPONSE else None)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _RECORD], schema=_RECORD)

    return run


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id -> refers_to of every page whose payload a smaller page_id holds."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size")).where("page_id is not null")
    keys = keys.where(F.col("size") >= least_bytes)
    first = keys.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("sha", "size", "refers_to")
    return keys.join(first, ["sha", "size"]).where("page_id > refers_to").select(F.col("page_id").alias("id"), F.col("sha").alias("of"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per page to bundles in ``folder`` (a URI all executors share); the index, written as well.

    Of equal payloads of at least ``least_bytes`` bytes the least page_id is the
    response, the others are revisits of it. Null html is an empty payload, a null
    url leaves the target out. A row without page_id has no record id and is
    not archived; a repeated row is archived again. Other columns are not read.
    A bundle of a failed attempt has a name of its own and is in no index row.
    """
    again = revisits(pages, least_bytes)
    html = F.col("html").cast("string")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).where("page_id is not null")
    typed = src.join(again, (F.col("page_id") == F.col("id")) & (F.sha1(F.coalesce("html", F.lit("")).cast("binary")) == F.col("of")), "left").select("page_id", "url", "html", "refers_to")
    return cut(typed.mapInArrow(tidy(_write(folder, frame_bytes, bundle_bytes)), ddl(_INDEX)))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The indexed records, read from their frames; a record is checked against its digest and length."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = index.repartition(4 * n, "bundle", F.floor(F.col("frame_start") / (8 << 20))).sortWithinPartitions("bundle", "frame_start", "offset")
    return near.mapInArrow(tidy(_read(folder)), ddl(_RECORD))


def new_folder(spark) -> str:
    """A folder of its own for a run's bundles, as a full URI; it goes when the session ends."""
    return removed_at_end(spark, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives to a new folder of the shared one and read them back."""
    folder = new_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT DISTINCT sha, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((CAST('0x' || sha[(i // 4) * 5 + 1:(i // 4) * 5 + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, strlen(p.html) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html JOIN d ON p.sha = d.sha
"""
