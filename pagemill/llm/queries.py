"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.ann import ORACLE as ann_sql
from pagemill.llm.merkle import ORACLE as manifest_sql
from pagemill.llm.ngram_join import ORACLE as join_sql
from pagemill.llm.prefix_trie import ORACLE as trie_sql
from pagemill.llm.quality_rules import ORACLE as rules_sql
from pagemill.llm.suffix_dedup import ORACLE as passages_sql
from pagemill.llm.warc import ORACLE as archive_sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.ngram_join import similar

    return similar(_read(spark, sf_dir, "documents"))


def op2_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pagemill.llm.sentencepiece import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.ann import nearest

    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.quality_rules import apply_rules

    return apply_rules(_read(spark, sf_dir, "documents"))


def op6_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.warc import archive_round_trip

    return archive_round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pagemill.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.language import identify_all

    return identify_all(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op9_additive_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.gam import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.suffix_dedup import dedup

    return dedup(_read(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.license_scan import scan

    return scan(_read(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.merkle import manifest

    return manifest(_read(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm.prefix_trie import trie

    return trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_sentencepiece_viterbi, op3_block_matrix_neighbours, op4_secret_scan, op5_line_frequency_rules,
        op6_seekable_warc, op7_hilbert_packing, op8_language_evidence, op9_additive_quality_model, op10_suffix_array_dedup, op11_license_scan, op12_merkle_manifest,
        op13_conversation_prefix_trie,
    )
}
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": join_sql, "op3_block_matrix_neighbours": ann_sql, "op5_line_frequency_rules": rules_sql,
    "op6_seekable_warc": archive_sql, "op10_suffix_array_dedup": passages_sql, "op12_merkle_manifest": manifest_sql, "op13_conversation_prefix_trie": trie_sql,
}
