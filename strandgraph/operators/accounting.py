"""What a run would move between host and device: sums over its frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.iterate import Run


def totals(run: Run) -> DataFrame:
    """Active and static vertices, on-demand vertices and bytes over all rounds."""
    m = run.metrics()
    return m.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in ("active_vertices", "active_edges", "static_vertices", "ondemand_vertices", "bytes_moved")))


def data_transport(run: Run, vertex_bytes: int = 4, edge_bytes: int = 8) -> DataFrame:
    """Bytes: the edges of every frontier, and an entry for each of its vertices."""
    m = run.metrics()
    return m.agg(F.coalesce(F.sum(F.col("active_edges") * edge_bytes + F.col("active_vertices") * vertex_bytes), F.lit(0)).cast("long").alias("data_transport"))
