"""Extraction from a folder that fills up: the scans are stateless, so they stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import api


def stream_pdfs(spark: SparkSession, path: str, files_each: int = 1000) -> DataFrame:
    """New files of a folder as (doc_id, content)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_each).load(path)
    return raw.select(F.col("path").alias("doc_id"), "content")


def stream_page_text(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Append the text of arriving files to a Parquet table; files that can't be loaded are passed over."""
    return api.page_text(stream_pdfs(spark, path), "skip").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
