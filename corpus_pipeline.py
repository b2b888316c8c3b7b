"""A training corpus from documents: quality filter, exact and near deduplication, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; `run` writes each stage's result as Parquet in the shared
folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm.exact_dedup import keep_first_copies
from noticeflow.llm.near_dedup import keep_one_of_each
from noticeflow.llm.packing import pack_documents
from noticeflow.llm.quality import keep_good
from noticeflow.llm.shared import Scratch
from noticeflow.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, likeness 0.8 or more."""
    return keep_one_of_each(docs, shingle=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048).drop("ids")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("best-fit packing", packing)]

#: Scores, signatures and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            scratch.drop(f"stage-{k - 2}")
    return docs
