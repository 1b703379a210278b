"""A corpus pipeline of five operators: language ID, near duplicates, decontamination, mixing, token files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import shared_dir
from runledger.llm.decontaminate import contaminated
from runledger.llm.jaccard_join import jaccard_components
from runledger.llm.language_id import held_out, identify, language_prototypes
from runledger.llm.mixing import mix_rows
from runledger.llm.token_ids import read_token_files, write_token_files

#: A text of at least so many characters whose best cosine is below this is in none of the learned languages; shorter texts say too little.
LEAST_SCORE, LEAST_LENGTH = 0.2, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and long ones far from every learned language."""
    found = identify(docs, language_prototypes(docs.where(~held_out())), keep=tuple(docs.columns), names=("__lang", "__cosine"))
    near = (F.col("__cosine") >= LEAST_SCORE) | (F.length("text") < LEAST_LENGTH)
    return found.where((F.col("__lang") != "und") & near).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of linked documents, and rows without an id."""
    others = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with its own or other parameters. Rows without an id aren't checked and stay."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: not at all, once or twice."""
    return mix_rows(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back."""
    return read_token_files(write_token_files(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Models, random rounding and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
