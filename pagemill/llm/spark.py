"""Session helpers of the corpus operators: part counts, checkpoints, arrow rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size (exact for a file scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The size of a frame of texts: Catalyst's estimate, or a sum over the rows where it has none (2^63 then)."""
    size = input_bytes(df)
    return size if size < 1 << 60 else int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 16)).first()[0] or 0)


def part_count(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Parts for a keyed exchange of packed rows: grows with the input, so that a part stays a few MB."""
    conf = int(session(df).conf.get("spark.sql.shuffle.partitions"))
    return max(4 * conf, text_bytes(df) // bytes_each)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as a full URI: spark.checkpoint.dir of the session.

    Where it is unset, a local session (a test, a trial) takes the context's checkpoint
    folder or a temporary one; on a cluster that is an error, as no folder of one machine will do.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagemill-")
        sc.setCheckpointDir(named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def removed_at_end(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the session ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to a table in the shared folder and go on from there, free of its lineage.

    A table, unlike an RDD checkpoint, is compressed, read by column and of known size.
    It goes when the session ends.
    """
    spark = session(df)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashed(df: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows, those of least hash of their key.

    Rows far above the cut are left out by a plain filter first, so a task sends the
    sorter its share of some ``most`` rows, not ``most`` rows itself.
    """
    n = df.count()
    h = F.xxhash64(key)
    if n > most:
        span = 1 << 30
        df = df.where(F.shiftrightunsigned(h, 34) < int(span * min(1.0, (most + 6 * most**0.5 + 20) / n)) + 1)
        return df.orderBy(F.shiftrightunsigned(h, 34), h, key, *ties).limit(most)
    return df


def table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema}, schema)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def joined(tbl: pa.Table, name: str, dtype) -> np.ndarray:
    """All binaries of a column, one after another, as one array."""
    return np.frombuffer(b"".join(x for x in tbl.column(name).to_pylist() if x), dtype)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)
