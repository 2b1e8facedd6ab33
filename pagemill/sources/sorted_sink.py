"""A sink whose files hold ascending ranges of a key, with a manifest that is written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.scan import dealt


def write_sorted(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Write the rows in order of ``by`` (nulls first) to ``path``/data, and return the manifest, written to ``path``/manifest.

    Ranges are sampled, and a key of very many rows spreads over files by a hash of the whole row, which stays what it is
    when a task runs again. The manifest has, for each file, its number, name, rows, the rows before it, first and last
    key. It is written once the data is committed: a folder without it is not a finished one.
    """
    spark = df.sparkSession
    dealt(df.withColumn("_tie", F.xxhash64(*df.columns)), [*by, "_tie"]).drop("_tie").write.parquet(f"{path}/data")
    key = F.struct(*by)
    files = spark.read.parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_at"))
    ends = files.groupBy("file").agg(F.count("*").alias("n_rows"), F.min_by(key, "_at").alias("first_key"), F.max_by(key, "_at").alias("last_key"))
    ranked = ends.selectExpr("*", "row_number() over (order by first_key, last_key, file) - 1 as number")  # a row a file: bounded by the number of ranges
    ranked.selectExpr("number", "file", "n_rows", "sum(n_rows) over (order by number) - n_rows as before", "first_key", "last_key").coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_sorted(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows of a finished folder with their place in its order, from 0: the rows of the files before, and the row's own number."""
    manifest = F.broadcast(spark.read.parquet(f"{path}/manifest").select(F.col("file").alias("_file"), "before"))
    rows = spark.read.parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(manifest, F.col("_name") == F.col("_file")).withColumn(place, F.col("before") + F.col("_at")).drop("_file", "_name", "_at", "before")
