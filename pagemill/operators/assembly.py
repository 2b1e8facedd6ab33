"""Documents put together in rows of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scan import running
from pagemill.plans.session import cut


def document_chunks(pages: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(doc_id, page, text) -> (doc_id, chunk, first_page, last_page, text): texts of a document in order, joined, a row a chunk.

    A chunk begins at a multiple of ``limit`` bytes or at the first piece after it, and a longer page is cut into pieces of
    ``limit`` characters at most, so no row has more than ``limit`` + 4 * ``limit`` bytes, and all chunks of a document, one after
    another, are its pages. A null text is empty; a document of empty pages has one chunk. Pages of one number stand by their text.
    """
    size = F.length("text")
    p = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("_t", F.xxhash64("text"))
    starts = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(limit))
    pieces = p.select("doc_id", "page", "_t", F.explode(F.transform(starts, lambda a: F.struct(a.alias("piece"), F.substring("text", a + 1, F.lit(limit)).alias("text")))).alias("x")).select("doc_id", "page", "_t", "x.*")
    order = ["page", "tie", "piece"]
    w = cut(pieces.withColumnRenamed("_t", "tie").withColumn("bytes", F.octet_length("text").cast("long")))
    at = running(w, ["doc_id"], order, {"upto": F.col("bytes")}).withColumn("chunk", F.floor((F.col("upto") - F.col("bytes")) / limit))
    return at.groupBy("doc_id", "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY page, tie, piece)").alias("text"))
