"""Degrees, compressed sparse rows and the statistics that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.functions.scans import BLOCK, compact, prefix_sum
from strandgraph.graph import Graph

BIG_SOURCE = 3000
BIG_NODE = 32


def _degrees(g: Graph, end: str, name: str) -> DataFrame:
    counted = g.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return g.vertices.join(counted, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def out_degrees(g: Graph) -> DataFrame:
    """(id, out_degree), 0 for vertices without out-edges."""
    return _degrees(g, "src", "out_degree")


def in_degrees(g: Graph) -> DataFrame:
    return _degrees(g, "dst", "in_degree")


def csr(g: Graph) -> DataFrame:
    """(id, ptr, degree): where each vertex's edges begin if edges lie in order of source."""
    degrees = out_degrees(g).withColumnRenamed("out_degree", "degree")
    return prefix_sum(degrees, "degree", "ptr", inclusive=False).select("id", "ptr", "degree")


def csr_degrees(rows: DataFrame, n_edges: int, block: int = BLOCK) -> DataFrame:
    """Degrees from pointers alone: the next pointer, or the number of edges, less the own one.

    The next pointer of a block's last row is the next block's first.
    """
    dealt = rows.select("id", "ptr", F.floor(F.col("id") / block).alias("_block"))
    firsts = dealt.groupBy("_block").agg(F.min("ptr").alias("_first"))
    firsts = firsts.select("_block", F.lead("_first", 1, n_edges).over(W.orderBy("_block")).alias("_next"))  # one row a block
    own = F.lead("ptr").over(W.partitionBy("_block").orderBy("id"))
    return dealt.withColumn("_own", own).join(firsts, "_block").select("id", (F.coalesce("_own", "_next") - F.col("ptr")).cast("long").alias("degree"))


def max_degree(g: Graph) -> DataFrame:
    return out_degrees(g).agg(F.max("out_degree").alias("max_degree"))


def average_degree(g: Graph) -> DataFrame:
    """Edges by vertices, rounded down."""
    return out_degrees(g).agg(F.expr("coalesce(sum(out_degree), 0) div greatest(count(*), 1)").alias("average_degree"))


def big_node_count(g: Graph, least: int = BIG_NODE) -> DataFrame:
    return out_degrees(g).agg(F.count_if(F.col("out_degree") >= least).alias("big_nodes"))


def _big(g: Graph, over: int) -> DataFrame:
    """Vertices with a degree over the threshold, without the last vertex."""
    top = g.vertices.agg(F.max("id").alias("top"))
    return out_degrees(g).where(F.col("out_degree") > over).join(F.broadcast(top), F.col("id") < F.col("top")).select("id")  # one row


def next_big_node(g: Graph, last: int, over: int = BIG_SOURCE) -> DataFrame:
    """The first such vertex after ``last``, or ``last`` if there is none."""
    return _big(g, over).where(F.col("id") > last).agg(F.coalesce(F.min("id"), F.lit(last)).cast("long").alias("node"))


def first_big_node(g: Graph, over: int = BIG_SOURCE) -> int:
    found = next_big_node(g, -1, over).first()["node"]
    if found < 0:
        raise ValueError(f"no vertex has a degree over {over}")
    return found


def big_node_sources(g: Graph, over: int = BIG_SOURCE, n: int = 5) -> DataFrame:
    """(run, source): the first ``n`` such vertices after vertex 0; the last one again where there are fewer, 0 where there is none."""
    spark = g.vertices.sparkSession
    first = compact(_big(g, over).where("id > 0").orderBy("id").limit(n)).select(F.col("position").alias("p"), "id")
    runs = spark.range(n).select(F.col("id").cast("int").alias("run"))
    joined = runs.join(first, F.col("run") == F.col("p"), "left")
    last = F.last("id", ignorenulls=True).over(W.orderBy("run").rowsBetween(W.unboundedPreceding, 0))  # n rows
    return joined.select("run", F.coalesce(last, F.lit(0)).cast("long").alias("source"))


def has_reciprocal_edge(g: Graph) -> DataFrame:
    """Whether some edge's reverse is an edge; a self-loop is its own reverse."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = g.edges.select("src", "dst").join(back, ["src", "dst"], "left_semi").limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("reciprocal"))
