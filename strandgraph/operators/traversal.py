"""Breadth-first levels, shortest distances and minimum-label components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions.degrees import csr
from strandgraph.functions.frontier import resident
from strandgraph.graph import Graph
from strandgraph.operators.iterate import Run, iterate

#: What unreached vertices have in the array formats: the largest unsigned number, or one more than the number of vertices.
INFINITY = (1 << 32) - 1


def _from_source(g: Graph, source: int) -> DataFrame:
    start = F.col("id") == source
    return g.vertices.select("id", F.when(start, F.lit(1).cast("long")).alias("value"), start.alias("active"))


def _region(g: Graph, cap: int | None) -> DataFrame:
    inside = F.lit(False) if cap is None else resident(F.col("ptr"), F.col("degree"), F.lit(cap))
    return csr(g).select("id", "degree", inside.alias("is_static"))


def bfs_run(g: Graph, source: int, measured: bool = False, cap: int | None = None) -> Run:
    g = g.written()
    return iterate(_from_source(g, source), g.out, lambda value, _: value + 1, algo="bfs", measured=measured, region=_region(g, cap) if measured else None)


def bfs(g: Graph, source: int) -> DataFrame:
    """(id, level): 1 at the source, null where it doesn't reach."""
    return bfs_run(g, source).state.select("id", F.col("value").alias("level"))


def sssp_run(g: Graph, source: int, measured: bool = False, cap: int | None = None) -> Run:
    g = g.written()
    return iterate(_from_source(g, source), g.out, lambda value, weight: value + weight, algo="sssp", measured=measured, region=_region(g, cap) if measured else None, edge_bytes=8)


def sssp(g: Graph, source: int) -> DataFrame:
    """(id, distance): 1 at the source plus the least weight of a path, null where there is none.  Weights aren't negative."""
    return sssp_run(g, source).state.select("id", F.col("value").alias("distance"))


def cc_run(g: Graph, measured: bool = False, cap: int | None = None) -> Run:
    g = g.written()
    state = g.vertices.select("id", F.col("id").alias("value"), F.lit(True).alias("active"))
    return iterate(state, g.out, lambda value, _: value, algo="cc", measured=measured, region=_region(g, cap) if measured else None)


def cc(g: Graph) -> DataFrame:
    """(id, label): the least id from which a vertex can be reached; on a symmetric graph, that of its component."""
    return cc_run(g).state.select("id", F.col("value").alias("label"))


def bfs_multi_source(g: Graph, sources: Sequence[int]) -> DataFrame:
    """(source, id, level) of reached vertices for several sources in one loop.

    Unreached pairs have no row in the result.
    """
    spark = g.vertices.sparkSession
    g = g.written()
    seeds = spark.createDataFrame([(s,) for s in dict.fromkeys(sources)], "id long").join(g.vertices, "id", "left_semi")  # as many rows as sources
    state = seeds.select(F.col("id").alias("source"), "id", F.lit(1).cast("long").alias("value"), F.lit(True).alias("active"))
    done = iterate(state, g.out, lambda value, _: value + 1, keys=("source",), algo="bfs", sparse=True).state
    return done.select("source", "id", F.col("value").alias("level"))


def with_sentinel(values: DataFrame, column: str, sentinel: int) -> DataFrame:
    """Unreached vertices get a number in place of null."""
    return values.withColumn(column, F.coalesce(column, F.lit(sentinel).cast("long")))


def reached_count(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.count(column).alias("reached"))


def frontier_sizes(levels: DataFrame) -> DataFrame:
    """(iteration, active_vertices): a vertex is in the frontier once, in the round of its level."""
    return levels.where("level IS NOT NULL").groupBy((F.col("level") - 1).cast("int").alias("iteration")).agg(F.count(F.lit(1)).alias("active_vertices"))


def component_count(labels: DataFrame) -> DataFrame:
    """Vertices that keep their own id as label."""
    return labels.agg(F.count_if(F.col("id") == F.col("label")).alias("components"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def head_tail_sample(values: DataFrame, head: int = 10) -> DataFrame:
    """The rows of the lowest ids and that of the highest."""
    last = values.orderBy(F.desc("id")).limit(1)
    return values.orderBy("id").limit(head).unionByName(last)
