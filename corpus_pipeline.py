"""The corpus pipeline: language, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each
stage's result to the shared folder and reads it back for the next. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.language import identify_documents
from pagemill.llm.ngram_join import similar
from pagemill.llm.packing import pack
from pagemill.llm.secrets import redact
from pagemill.llm.spark import cut, removed_at_end, shared_folder
from pagemill.llm.suffix_dedup import dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a column that tells each row from all others and follows doc_id.

    That is doc_id where no row lacks or repeats it; else the rows are written once with
    a number, in the order of doc_id (rows without one last).
    """
    r = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if r["n"] == r["ids"]:
        return docs, "doc_id"
    ordered = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i")).orderBy(F.asc_nulls_last("doc_id"), "_h", "_i")
    return cut(ordered.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))), "_row"


def _without(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return docs.join(rows, key, "left_anti").select(*COLUMNS)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or no clear evidence) go.

    Each row is judged by itself, also where its doc_id is null or repeated.
    """
    docs, key = _keyed(docs)
    rejected = cut(identify_documents(docs, key).where("not kept").select(key))  # a table of known size: where it is small, the texts need no exchange
    return _without(docs, rejected, key)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row stays: that with the least doc_id.

    Rows that share a doc_id are documents of their own, and copies if their texts are;
    one without doc_id stays only where no other of its group has one.
    """
    docs, key = _keyed(docs)
    verdict = similar(docs.select(F.col(key).alias("doc_id"), "text"))
    return _without(docs, verdict.where("component_id <> doc_id").select(F.col("doc_id").alias(key)), key)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that an earlier document holds are cut out.

    Earlier means a smaller doc_id; rows that share one are put in a fixed order, and
    rows without one come last.
    """
    docs, key = _keyed(docs)
    if key == "doc_id":
        return _measured(dedup(docs.select(*COLUMNS), text_out=True))
    out = dedup(docs.withColumnRenamed("doc_id", "_given").withColumnRenamed(key, "doc_id"), text_out=True)
    return _measured(out.drop("doc_id").withColumnRenamed("_given", "doc_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, with or without a doc_id of its own."""
    return _measured(redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, documents in Hilbert order; every row is packed, also with a null or repeated doc_id."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: Text likelihoods, the forest and the tokeniser have no SQL form. tests/llm holds near copies, passages and packing against
#: brute force, the language posterior against a plain computation, and secrets against planted ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = removed_at_end(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
