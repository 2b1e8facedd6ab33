"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are quantised once, and their int8 codes, with scale and error norm, are dealt into
cells (query block x vector group). In a cell a tile of code products bounds every
inner product from both sides; pairs that can still be among the k nearest survive, first by
the bounds of their cell, where a second int8 code of the rounding error narrows them, then by those of all cells of their query. Only survivors fetch
the original vectors, are computed in double precision, and merged by a heap for
each query. The bounds are exact, so recall is 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.bytesio import tidy
from pagemill.llm.spark import batch, cut, table
from pagemill.llm.suffix_dedup import ddl

TILE = 1024
_CODE = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()), ("scale", pa.float64()), ("norm", pa.float64()), ("err", pa.float64()), ("more", pa.binary()), ("more_scale", pa.float64()), ("more_err", pa.float64())])
_PAIR = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
_OUT = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of x, norm of the error) of each row."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt((x * x).sum(1)), np.sqrt(((x - code * scale[:, None]) ** 2).sum(1))


def tile_bounds(q, v) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two quantised blocks.

    a.b - a'.b' = a.(b - b') + (a - a').b', so the error is at most
    |a| |b - b'| + |a - a'| (|b| + |b - b'|). The code products are integers of at
    most 2^14 times the dimension, exact in float32 for up to 1024 dimensions (float64 beyond).
    """
    kind = np.float32 if q[0].shape[1] <= 1024 else np.float64
    mid = (q[0].astype(kind) @ v[0].astype(kind).T).astype(np.float64) * (q[1][:, None] * v[1][None, :])
    err = q[2][:, None] * v[3][None, :] + q[3][:, None] * (v[2] + v[3])[None, :]
    err += 1e-9 * (1e-300 + q[2][:, None] * v[2][None, :])
    return mid - err, mid + err


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component on."""
    acc = np.zeros(len(a))
    for d in range(a.shape[1]):
        acc += a[:, d] * b[:, d]
    return acc


def _codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quantised form of each vector; rows of one dimension together."""
    for b in batches:
        row, ids, dim, lists = (b.column(k) for k in range(4))
        sizes = dim.to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            at = pa.array(np.flatnonzero(sizes == d))
            x = lists.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
            code, scale, norm, err = quantise(x)
            rest = x - code * scale[:, None]
            more, more_scale, _, more_err = quantise(rest)
            yield batch({"row": row.take(at), "id": ids.take(at), "dim": np.full(len(at), d, np.int32), "code": [c.tobytes() for c in code], "scale": scale, "norm": norm, "err": err, "more": [c.tobytes() for c in more], "more_scale": more_scale, "more_err": more_err}, _CODE)


def _block(tbl: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple, tuple]:
    """(rows, ids, codes, (vectors of both codes, norm, norm of the error left)) of a cell's side."""
    get = lambda c: tbl.column(c).to_numpy()
    code, more = (np.frombuffer(b"".join(tbl.column(c).to_pylist()), np.int8).reshape(tbl.num_rows, -1) for c in ("code", "more"))
    both = code * get("scale")[:, None] + more * get("more_scale")[:, None]
    return get("row").astype(np.int64), get("id").astype(np.int64), (code, get("scale"), get("norm"), get("err")), (both, get("norm"), get("more_err"))


def fine_bounds(q, v, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of the pairs (i, j), by both codes; the error is bounded as in tile_bounds."""
    mid = np.einsum("ij,ij->i", q[0][i], v[0][j])
    err = q[1][i] * v[2][j] + q[2][i] * (v[1] + v[2])[j] + 1e-9 * (1e-300 + q[1][i] * v[1][j])
    return mid - err, mid + err


def search_cell(q_ids, q, q_fine, v_ids, v, v_fine, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, lower bound, upper bound) of the pairs that may be among a query's k nearest."""
    bound = np.full(len(q_ids), -np.inf)
    tops = np.full((len(q_ids), 0), -np.inf)
    found = []
    for at in range(0, len(v_ids), TILE):
        part = slice(at, at + TILE)
        low, high = tile_bounds(q, tuple(x[part] for x in v))
        own = q_ids[:, None] == v_ids[part][None, :]
        low[own] = high[own] = -np.inf
        best = _kth(np.concatenate([tops, low], 1), k)[1]
        i, j = np.nonzero((high >= np.maximum(bound, best)[:, None]) & ~own)
        least, most = fine_bounds(q_fine, tuple(x[part] for x in v_fine), i, j)
        low[i, j] = least
        tops, best = _kth(np.concatenate([tops, low], 1), k)
        bound = np.maximum(bound, best)
        keep = most >= bound[i]
        found.append((i[keep], j[keep] + at, least[keep], most[keep]))
    i, j, least, most = (np.concatenate(x) for x in zip(*found))
    keep = most >= bound[i]
    return i[keep], j[keep], least[keep], most[keep]


def _kth(low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest lower bounds of each row, and the least of them (minus infinity where there are fewer)."""
    if low.shape[1] > k:
        low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
    return low, low.min(1) if low.shape[1] == k else np.full(len(low), -np.inf)


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table({n: [] for n in _PAIR.names}, _PAIR)
        q_row, q_ids, q, q_fine = _block(left)
        v_row, v_ids, v, v_fine = _block(right)
        i, j, low, high = search_cell(q_ids, q, q_fine, v_ids, v, v_fine, k)
        return table({"q": q_row[i], "v": v_row[j], "low": low, "high": high}, _PAIR)

    return run


def _merge(k: int):
    """Rows of a query stand together: exact products, and a heap of its k best."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []

        def flush():
            best = sorted(heap, key=lambda x: (-x[0], -x[1]))
            return batch({"query_id": [query] * len(best), "rank": range(1, len(best) + 1), "vec_id": [-m for _, m in best], "score": [s for s, _ in best]}, _OUT)

        for b in batches:
            ids, others, dims = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            score = np.zeros(b.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, y = (b.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d) for c in (3, 4))
                score[at] = exact(x, y)
            for a, v, s in zip(ids.tolist(), others.tolist(), score.tolist()):
                if a != query:
                    if heap:
                        yield flush()
                    query, heap = a, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        if heap:
            yield flush()

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v, dim of the vectors that take part: not null, not zero, all components finite."""
    given = vectors.schema[column].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast(kind).alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return named.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, query_block: int = 4096, vector_block: int = 32768) -> DataFrame:
    """The k vectors of largest inner product of each query: query_id, rank, vec_id, score.

    Both frames have (vec_id, embedding). Vectors that are null, zero or hold null
    or non-finite components take no part, nor do rows without vec_id; only
    vectors of the query's dimension are compared. A query is never its own
    neighbour (rows with its vec_id are left out); repeated rows of a vec_id count
    once for each row. Ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    number = F.monotonically_increasing_id()
    q, v = (cut(usable(x).select(number.alias("row"), "id", "dim", "v")) for x in (queries, vectors))
    n_q, n_v = q.count(), v.count()
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_q // query_block))
    groups = max(1, -(-n_v // vector_block), min(-(-cores // blocks), n_v // 1024))
    coded = lambda x: x.mapInArrow(tidy(_codes), ddl(_CODE))
    part = lambda c, m, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    qc = coded(q).select("*", part("id", blocks, 0).alias("qb"), each(groups).alias("vg"))
    vc = coded(v).select("*", part("id", groups, 1).alias("vg"), each(blocks).alias("qb"))
    pairs = qc.groupBy("dim", "qb", "vg").cogroup(vc.groupBy("dim", "qb", "vg")).applyInArrow(_cell(k), ddl(_PAIR))
    # a query's k-th greatest lower bound over all cells is what its nearest must reach
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    reach = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("q"))
    pairs = pairs.withColumn("place", place).withColumn("least", reach).where("least is null or high >= least").select("q", "v")
    near = pairs.join(v.select(F.col("row").alias("v"), F.col("id").alias("vec_id"), F.col("v").alias("y")), "v")
    both = near.join(q.select(F.col("row").alias("q"), F.col("id").alias("query_id"), "dim", F.col("v").alias("x")), "q")
    rows = both.select("query_id", "vec_id", "dim", "x", "y").repartition("query_id").sortWithinPartitions("query_id")
    return rows.mapInArrow(tidy(_merge(k)), ddl(_OUT))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
