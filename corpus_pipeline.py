"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import bpe, decontamination, quality, secrets, simhash
from factgraph.runtime import materialize, table

#: The classifier, the linked classes and the tokens are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go; null and empty texts do, repeated rows, null ids and further columns stay."""
    return quality.kept_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest doc_id; of repeated rows one does, rows without a doc_id all stay."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a region of a benchmark text go; null texts, null ids, repeated rows and further columns stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeated ones too, their secrets are masked, and n_chars counts what is left, null for a null text."""
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids (binary, little-endian unsigned 32-bit integers) of each document, their count, and digests of them and of the text decoded from them.

    Null texts are empty; null ids and repeated rows stay; further columns end here.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, packed=True)
    return bpe.digests(bpe.bpe_decode(ids, path), "ids")


STAGES = [("quality_rules", quality_stage), ("simhash_near_dedup", near_dedup_stage),
          ("benchmark_decontamination", decontamination_stage), ("secret_scans", secrets_stage),
          ("byte_level_bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
