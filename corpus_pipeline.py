"""A training corpus in five stages, each written as Parquet and read again by the next.

Quality rules reject documents, exact and near copies go, sources are mixed to
target weights, and what is left is encoded.  Every stage but the last returns
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.checkpoints import checkpoint_dir
from strandgraph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from strandgraph.llm.common import broadcast_if_small, cut, discard, documents, row_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their rules and whose host passes; rejected ones go.

    Null and empty texts fail; repeated rows are judged each; an empty table stays empty.
    """
    return quality.kept_rows(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest; rows that repeat an id and its text are one document.

    Null texts equal empty ones; null ids lose ties; an empty table stays empty.
    """
    return exact_dedup.kept_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies.

    Rows without an id and texts without a word stay; rows that repeat an id share its verdict; an empty table stays empty.
    """
    verdicts = near_dedup.near_dedup(docs)
    gone = cut(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct())
    whole = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("own_id"))
    return whole.join(broadcast_if_small(gone), F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go.

    Texts without a word have size 0 and are taken as often as whole copies of their source are;
    repeated rows are documents of their own; null is a source; an empty table stays empty.
    """
    return mixing.taken_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each row; null text is empty, repeated rows are encoded each."""
    return bpe.digest_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL can't express near_dedup; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input is deleted once its output is written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
