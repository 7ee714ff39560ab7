"""Prefix sums and compaction over a global order, in two levels.

A window without partitions would move every row to one task.  Ids are cut into
blocks; sums of blocks are scanned (one row a block), and each block is scanned by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def prefix_sum(df: DataFrame, value: str, out: str, inclusive: bool, order: str = "id", block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over rows of lower ``order`` (and the row's own, if inclusive).  ``order`` is a unique long."""
    cut_ = F.floor(F.col(order) / block)
    dealt = df.withColumn("_block", cut_)
    sums = dealt.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_block", before.alias("_start"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(starts, "_block").withColumn(out, (F.col("_start") + F.col("_own")).cast("long")).drop("_block", "_own", "_start")


def compact(frontier: DataFrame, out: str = "position", block: int = BLOCK) -> DataFrame:
    """Each row's place among all rows in order of id, from 0."""
    return prefix_sum(frontier.withColumn("_one", F.lit(1).cast("long")), "_one", out, inclusive=False, block=block).drop("_one")
