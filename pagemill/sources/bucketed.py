"""Page relations kept as bucketed tables, so that they join and group without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = ("doc_id", "page")


def save_bucketed(relations: dict[str, DataFrame], prefix: str, buckets: int = 200, key: tuple[str, ...] = KEY, folder: str | None = None) -> dict[str, str]:
    """Write each relation as the table ``prefix``_name, in ``buckets`` buckets of ``key``, sorted by it: name -> table.

    The rows are dealt once, at the write (a bucket is one file). A document of very many pages spreads over all buckets, as the
    page is part of the key. Relations that are to meet need one number of buckets.
    ``folder``: where the tables' files go; the warehouse, if it is not given.
    """
    out = {}
    for name, df in relations.items():
        out[name] = f"{prefix}_{name}"
        writer = df.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).format("parquet").mode("overwrite")
        (writer.option("path", f"{folder}/{out[name]}") if folder else writer).saveAsTable(out[name])
    return out


def load_bucketed(spark: SparkSession, tables: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.table(table) for name, table in tables.items()}
