"""Lineage cut by tables in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full URI; where it is unset, a local session takes its checkpoint folder or a temporary one, and a cluster none."""
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


#: Most bytes of an Arrow batch of rows on its way to Python.
BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let rows go to Python in batches of at most BATCH bytes, whatever the length of their values; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and continue from there; the table goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
