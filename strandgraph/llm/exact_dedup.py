"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters (``freqItems``) name the digests that may hold a large share
of all rows.  Their groups are verified exactly and, being at most ``1 / support``
rows, their winners are broadcast, so rows of large groups never meet in one
task.  All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import broadcast_if_small, cut, documents, row_of, squeezed

#: Digests with at least this share of the rows are certain to be found frequent; at most 1/SUPPORT are held.
SUPPORT = 1 / 1000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the original text, SHA-256 of the text without white space (null: empty)."""
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
        F.unhex(F.sha2(squeezed(F.col("text")).cast("binary"), 256)).alias("digest"),
    )


def _winner() -> list[Column]:
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")))
    return [best.alias("best"), F.count(F.lit(1)).alias("group_size")]


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """At most ``1 / support`` digests, among them every one held by more than that share of the rows."""
    return rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()


def grouped(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digests()`` rows with their group's size and best row, the struct ``best`` of (-size, whether the id is null, id)."""
    heavy = F.broadcast(frequent_digests(rows, support))  # at most 1/support digests
    winners = cut(rows.join(heavy, "digest", "left_semi").groupBy("digest").agg(*_winner()))
    hinted = F.broadcast(winners.withColumnRenamed("digest", "heavy"))  # at most 1/support rows, verified
    large = rows.join(hinted, F.col("digest") == F.col("heavy")).drop("heavy")
    rest = rows.join(hinted, F.col("digest") == F.col("heavy"), "left_anti")
    small = rest.join(rest.groupBy("digest").agg(*_winner()), "digest")
    columns = ["doc_id", "size", "digest", "best", "group_size"]
    return large.select(*columns).unionByName(small.select(*columns))


def group_exact(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """For ``digests()`` rows: doc_id, keep_id, group_size, kept, text_sha256; one row for each row.

    Defined results: null text equals empty text; ties in length go to the
    smallest doc_id, null last; repeated rows count in ``group_size`` and agree
    with each other; an empty table gives an empty result.
    """
    return grouped(rows, support).select(
        "doc_id",
        F.col("best.d").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.d")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One whole row of each group of equal texts: the longest, then that of the smallest id, null last.

    Rows that share id, length and normalised text are one document, of which any row stays;
    null texts equal empty ones; an empty table gives an empty result.
    """
    digested = cut(digests(docs))
    lost = ~(F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("size") == -F.col("best.s")))
    gone = cut(grouped(digested, support).where(lost).select(F.struct("doc_id", "digest", "size").alias("gone")).distinct())
    own = docs.select(row_of(docs), F.struct("doc_id", F.unhex(F.sha2(squeezed(F.col("text")).cast("binary"), 256)).alias("digest"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size")).alias("own"))
    same = lambda c: F.struct(F.coalesce(F.col(f"{c}.doc_id"), F.lit(0)), F.col(f"{c}.doc_id").isNull(), F.col(f"{c}.digest"), F.col(f"{c}.size"))
    left = own.join(broadcast_if_small(gone, 50_000), same("own") == same("gone"), "left_anti")
    repeated = digested.groupBy("doc_id", "digest", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["own"])
    return left.select("row.*")


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Group ``docs`` by their text without white space; see ``group_exact``."""
    return group_exact(cut(digests(docs)), support)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY size DESC, doc_id ASC) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
