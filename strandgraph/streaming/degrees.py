"""Degrees kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_out_degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree) for a streaming table of edges; write it in complete or update mode.  State is one row a vertex."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def windowed_activity(edges: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, edges, sources) of each window of event time; rows later than ``late`` are left out, and state older than it is dropped."""
    seen = edges.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"))
    return seen.agg(F.count(F.lit(1)).alias("edges"), F.approx_count_distinct("src").alias("sources")).select(F.col("w.start").alias("start"), "edges", "sources")
