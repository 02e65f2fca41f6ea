"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, jaccard_join, language_id, lexical_search, mixing, near_dedup, pii, sharding, substring_dedup, token_alignment, token_files, warc
from .common import text_or_empty


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain benchmark items, a row per document and item."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.sharded(spark, _table(spark, sf_dir, "documents"), 40)
    crc = F.crc32(F.encode(text_or_empty("text"), "UTF-8"))
    return shards.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files_round_trip(spark, _table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return token_alignment.align_tokens(_table(spark, sf_dir, "documents"), groups=False).select(*columns)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_decontamination, op2_exact_dedup, op3_warc, op4_near_dedup, op5_substring_dedup, op6_mixing, op7_sharding, op8_token_files, op9_pii, op10_language_id, op11_lexical_search, op12_token_alignment, op13_jaccard_join, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL}
