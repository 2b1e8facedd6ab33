"""Packing of documents into token sequences along a space-filling curve.

A document's hashed byte-trigram vector is projected to three normal
coordinates; their Hilbert key places like documents near each other. Keys and
texts are written once; a grouped sum over cells of the curve then cuts it into
ranges of like size. Documents are sorted along each range, laid end to end and cut at the
sequence length, so only the last sequence of a range has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bpe import encoder
from pagemill.llm.bytesio import U64, ids_of, mix, slices, tidy
from pagemill.llm.spark import batch, cut
from pagemill.llm.suffix_dedup import ddl

BITS, DIMS = 10, 3
#: Cells of the curve that are weighed: what the driver reads has 2^CELL_BITS rows at most.
CELL_BITS = 15
LARGE_RANGE = 8 << 20
#: Ranges of any input: 100 TB make ranges of 1 GB.
MOST_RANGES = 100_000
_KEYED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("size", pa.int64()), ("key", pa.int64()), ("salt", pa.int64())])
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points x[n, d] with ``bits`` bits a coordinate (Skilling's transpose form)."""
    x = x.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            has = (x[i] & q) != 0
            t = np.where(has, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(has, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    g = np.random.Generator(np.random.PCG64(7))
    return g.standard_normal((1 << 12, DIMS)).astype(np.float32)


_PLANE = _projection()


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Projected hashed trigram vectors, scaled to (0, 1) a coordinate."""
    n = len(off) - 1
    size = np.diff(off)
    if len(data) < 3:
        return np.full((n, DIMS), 0.5)
    gram = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
    code = (gram * np.uint32(2654435761)) >> np.uint32(20)
    z = np.zeros((n, DIMS))
    full = size > 2
    for d in range(DIMS):
        total = np.append(0.0, np.cumsum(_PLANE[:, d][code], dtype=np.float64))
        z[full, d] = total[np.maximum(off[1:][full] - 2, off[:-1][full])] - total[off[:-1][full]]
    z /= np.maximum(size - 2, 1)[:, None]
    return 1 / (1 + np.exp(-z * 12))


def _key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in slices(batches, most=1 << 20):
        v = np.minimum((vectors(data, off) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        ids = rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64())
        salt = mix(ids_of_filled(ids).astype(U64)).view(np.int64)
        yield batch({"doc_id": ids, "text": rows.column(rows.schema.get_field_index("text")).cast(pa.string()), "size": np.diff(off) + 1, "key": hilbert(v, BITS), "salt": salt}, _KEYED)


def ids_of_filled(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(path: str, length: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sequence, at = TaskContext.get().partitionId() << 40, 0
        for rows, data, off in slices(batches, most=1 << 20):
            ids, bounds = enc.encode(data, off)
            docs = rows.column(rows.schema.get_field_index("doc_id"))
            n = np.diff(bounds) + 1
            flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
            first = np.cumsum(n) - n
            # cuts: document starts and sequence starts of this stretch
            starts = np.union1d(first, np.arange((-at) % length, len(flat), length))
            ends = np.append(starts[1:], len(flat))
            own = np.searchsorted(first, starts, "right") - 1
            place = at + starts
            raw = flat.tobytes()
            yield batch(
                {
                    "doc_id": docs.take(pa.array(own)).cast(pa.int64()), "start": starts - first[own], "length": ends - starts,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                    "doc_tokens": n[own], "sequence_id": sequence + place // length, "offset": place % length,
                },
                _PIECE,
            )
            at += len(flat)
            sequence, at = sequence + at // length, at % length

    return run


def range_table(weights: list[tuple[int, int]], bytes_each: int) -> list[tuple[int, int, int]]:
    """(cell, first range, how many ranges it reaches over) of cells in curve order."""
    out, at = [], 0
    for cell, size in sorted(weights):
        out.append((cell, at // bytes_each, (at + size - 1) // bytes_each - at // bytes_each + 1))
        at += size
    return out


def ranged(keyed: DataFrame, bytes_each: int) -> DataFrame:
    """Rows of (key, salt, size, ...) dealt into ranges of some ``bytes_each`` along the curve, sorted within.

    The weights of the 2^CELL_BITS cells of the curve come from one grouped sum; so what
    the driver holds has a fixed bound, at every input size. A cell that reaches over more
    than one range is dealt by salt. Ranges below LARGE_RANGE are no more than the session's partitions,
    and all are MOST_RANGES at most: beyond that they grow (a range is sorted, with spills, and packed as a stream).
    """
    cell = F.shiftright("key", BITS * DIMS - CELL_BITS).cast("int")
    weights = keyed.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")).collect()
    total = sum(r["size"] for r in weights)
    each = max(bytes_each, min(LARGE_RANGE, -(-total // int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))), -(-total // MOST_RANGES))
    deal = range_table([(r["cell"], r["size"]) for r in weights], each)
    n = deal[-1][1] + deal[-1][2] if deal else 1
    where = F.broadcast(keyed.sparkSession.createDataFrame(deal, "cell int, first long, many long"))
    dealt = keyed.withColumn("cell", cell).join(where, "cell").withColumn("range", F.col("first") + F.pmod("salt", "many"))
    return dealt.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "key", "salt")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, bytes_each: int = LARGE_RANGE) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids.

    Every id of every document lies in exactly one piece; a document ends with
    ``end_id``; a null or empty text is that id alone. A sequence has no gaps, and
    only the last of each range (of about ``bytes_each`` of text) is not
    full. Repeated rows are packed once each; a row without doc_id is packed
    with a null doc_id. Equal keys (copies) are told apart by a salt of doc_id, so a group of
    copies of any size is split. Other columns are not read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = cut(src.mapInArrow(tidy(_key), ddl(_KEYED)))
    return ranged(keyed, bytes_each).select("doc_id", "text").mapInArrow(tidy(_pack(path, length, end_id), lambda: encoder(path).forget()), ddl(_PIECE))
