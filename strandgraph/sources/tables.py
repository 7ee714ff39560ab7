"""Graphs derived from relational tables, and edge lists from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.graph import Graph

#: Ids are made disjoint by parity: customers and suppliers odd, parts even.


def supplier_part(spark: SparkSession, sf_dir: str, symmetric: bool = True) -> Graph:
    """Suppliers and the parts that they delivered; weight is the least quantity."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = lines.groupBy((F.col("l_suppkey") * 2 + 1).cast("long").alias("src"), (F.col("l_partkey") * 2).cast("long").alias("dst")).agg(F.min("l_quantity").cast("long").alias("weight"))
    g = Graph.from_edges(edges)
    return g.both_ways() if symmetric else g


def customer_part(spark: SparkSession, sf_dir: str, least_quantity: int | None = 49, symmetric: bool = True) -> Graph:
    """Customers and the parts that they ordered in at least ``least_quantity`` pieces: a sparse graph with long paths.  None: all parts that they ordered."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if least_quantity is not None:
        lines = lines.where(F.col("l_quantity") >= least_quantity)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = joined.groupBy((F.col("o_custkey") * 2 + 1).cast("long").alias("src"), (F.col("l_partkey") * 2).cast("long").alias("dst")).agg(F.min("l_quantity").cast("long").alias("weight"))
    g = Graph.from_edges(edges)
    return g.both_ways() if symmetric else g


def user_transitions(spark: SparkSession, sf_dir: str, days_apart: str = "day") -> Graph:
    """Directed: from the user of an event to the user of the next one; weight is how often.

    Events are in order of (ts, event_id).  The order is found day by day: a
    day's last event and the next day's first are joined by a window over days,
    which has one row a day.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc(days_apart, "ts").alias("day"), "ts", "event_id", "user_id")
    order = W.partitionBy("day").orderBy("ts", "event_id")
    within = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(order).alias("dst"))
    first, last = F.min(F.struct("ts", "event_id", "user_id"))["user_id"], F.max(F.struct("ts", "event_id", "user_id"))["user_id"]
    days = events.groupBy("day").agg(first.alias("first"), last.alias("last"))
    between = days.select(F.col("last").alias("src"), F.lead("first").over(W.orderBy("day")).alias("dst"))
    steps = within.union(between).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return Graph.from_edges(steps.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("weight")))


def edge_list(spark: SparkSession, path: str, sep: str = "\t", weighted: bool = False) -> Graph:
    """A text file with a source, a target and perhaps a weight in each line."""
    schema = "src long, dst long" + (", weight long" if weighted else "")
    edges = spark.read.csv(path, sep=sep, schema=schema, comment="#", mode="FAILFAST")
    return Graph.from_edges(edges if weighted else edges.withColumn("weight", F.lit(1).cast("long")))
