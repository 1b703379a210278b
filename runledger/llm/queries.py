"""The thin queries over whole tables, one for each operator; their DuckDB SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import oracles
from runledger.llm.decontaminate import contaminated
from runledger.llm.divergence_audit import divergence
from runledger.llm.filter_audit import audit_filters
from runledger.llm.jaccard_join import jaccard_components
from runledger.llm.language_id import identify_documents
from runledger.llm.license_scan import scan_licenses
from runledger.llm.lm_scoring import score_texts
from runledger.llm.mixing import mix
from runledger.llm.pii import personal_data
from runledger.llm.sharding import shard_by_bytes
from runledger.llm.token_ids import read_token_files, write_token_files
from runledger.llm.topk_search import top_k
from runledger.llm.url_reputation import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), 8)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(_table(spark, sf_dir, "documents"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the ``labels`` rows of a page's id: bad is low quality or toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op9_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_minimax_sharding, op2_language_id, op3_template_decontamination, op4_pivotal_mixing, op5_token_files,
        op6_license_scan, op7_ngram_jaccard_join, op8_url_reputation, op9_bit_sliced_topk, op10_lm_scoring,
        op11_filter_audit, op12_source_divergence, op13_personal_data,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Sharding, mixing, the models and the tokenizer are beyond SQL; their tests hold them against brute force."""
    return {
        "op6_license_scan": oracles.license_scan(),
        "op7_ngram_jaccard_join": oracles.JACCARD_JOIN,
        "op8_url_reputation": oracles.url_reputation(),
        "op9_bit_sliced_topk": oracles.TOPK,
        "op11_filter_audit": oracles.FILTER_AUDIT,
        "op12_source_divergence": oracles.DIVERGENCE,
    }
