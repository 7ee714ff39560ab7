"""Frontiers: the sub-graph of active vertices and how it is split by residency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.scans import compact, prefix_sum
from strandgraph.graph import Graph


def active_count(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(F.col("active").cast("long")), F.lit(0)).alias("active_vertices"))


def active_subgraph(g: Graph, active: DataFrame) -> DataFrame:
    """Edges whose source is active."""
    return g.edges.join(active.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "weight")


def subgraph_csr(rows: DataFrame, active: DataFrame) -> DataFrame:
    """(id, position, ptr, degree) of the active vertices as a graph of their own: compacted, with offsets from an exclusive scan."""
    kept = compact(rows.join(active.select("id"), "id", "left_semi").select("id", "degree"))
    return prefix_sum(kept, "degree", "ptr", inclusive=False).select("id", "position", "ptr", "degree")


def resident(ptr: Column, degree: Column, cap: Column | int) -> Column:
    """Whether all of a vertex's edges lie before ``cap``.

    The place of the last edge is ``ptr + degree - 1``; for a vertex at 0
    without edges that wraps to the largest unsigned number, so it isn't resident.
    """
    last = ptr + degree - 1
    return (ptr < cap) & (last >= 0) & (last < cap)


def static_region(rows: DataFrame, cap: int) -> DataFrame:
    """(id, is_static) for ``csr`` rows."""
    return rows.select("id", resident(F.col("ptr"), F.col("degree"), F.lit(cap)).alias("is_static"))


def frontier_split(active: DataFrame, region: DataFrame) -> DataFrame:
    """(id, part): 'static' or 'ondemand' for each active vertex."""
    return active.select("id").join(region, "id").select("id", F.when(F.col("is_static"), "static").otherwise("ondemand").alias("part"))


def region_edges(rows: DataFrame, cap: int) -> DataFrame:
    """Edges that are resident, and those that aren't."""
    inside = F.sum(F.when(resident(F.col("ptr"), F.col("degree"), F.lit(cap)), F.col("degree")).otherwise(0))
    return rows.agg(F.coalesce(inside, F.lit(0)).cast("long").alias("static_edges"), (F.coalesce(F.sum("degree"), F.lit(0)) - F.coalesce(inside, F.lit(0))).cast("long").alias("ondemand_edges"))
