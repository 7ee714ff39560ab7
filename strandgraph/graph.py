"""The graph: a table of edges (src, dst, weight) and a table of vertices (id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.checkpoints import cut


#: Out-edges of a vertex beyond which they are dealt in parts of about so many.
HUB = 1 << 22
#: Vertices that are dealt so, at most, those with the most edges: any other has at most a share of 1 / MOST_HUBS of all edges.
MOST_HUBS = 100_000


@dataclass(frozen=True)
class OutEdges:
    """Edges hashed and sorted by source, written; those of hubs (src, parts) are hashed by source and part instead."""

    plain: DataFrame
    hubs: DataFrame | None = None
    of_hubs: DataFrame | None = None

    @staticmethod
    def of(edges: DataFrame, hub: int | None = None) -> OutEdges:
        """``edges`` (src, ...) have been written: which part an edge goes to depends on its place."""
        hub = HUB if hub is None else hub
        plain = lambda some: cut(some.repartition("src").sortWithinPartitions("src"))
        if edges.count() <= hub:
            return OutEdges(plain(edges))
        degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub)
        hubs = cut(degrees.orderBy(F.desc("n"), "src").limit(MOST_HUBS).select("src", F.ceil(F.col("n") / hub).alias("parts")))
        if hubs.isEmpty():
            return OutEdges(plain(edges))
        few = F.broadcast(hubs)  # MOST_HUBS rows
        part = F.pmod(F.xxhash64("_at"), "parts").alias("part")
        dealt = edges.withColumn("_at", F.monotonically_increasing_id()).join(few, "src").select("src", part, *(c for c in edges.columns if c != "src"))
        return OutEdges(plain(edges.join(few, "src", "left_anti")), hubs, cut(dealt.repartition("src", "part").sortWithinPartitions("src", "part")))

    def sent(self, front: DataFrame) -> DataFrame:
        """Rows of ``front`` (src, ...) with their out-edges: a hub's row goes to each of its parts."""
        sent = front.join(self.plain, "src")
        if self.hubs is None:
            return sent
        copies = front.join(F.broadcast(self.hubs), "src").withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")  # MOST_HUBS rows
        return sent.unionByName(copies.join(self.of_hubs, ["src", "part"]).drop("part"))

    def only(self, targets: DataFrame) -> OutEdges:
        """The edges into ``targets`` (dst)."""
        keep = lambda edges: cut(edges.join(targets, "dst", "left_semi").select(*edges.columns))
        return OutEdges(keep(self.plain), self.hubs, None if self.hubs is None else keep(self.of_hubs))


@dataclass(frozen=True)
class Graph:
    """Parallel edges and self-loops are kept as they come."""

    edges: DataFrame
    vertices: DataFrame
    #: The edges as loops join them, if ``written`` has made the graph.
    out: OutEdges | None = None

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Vertices default to the ends of the edges; weight to 1."""
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1).cast("long"))
        edges = edges.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "weight")))
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(edges, vertices.select(F.col("id").cast("long").alias("id")))

    def both_ways(self) -> Graph:
        """With every edge's reverse added; parallel edges stay."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return Graph(self.edges.unionByName(back), self.vertices)

    def symmetrized(self) -> Graph:
        """Every edge both ways, parallel edges merged to the least weight."""
        return Graph(self.both_ways().edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), self.vertices)

    def dense(self) -> Graph:
        """Vertices 0 to the largest id, as the array formats have them."""
        top = self.vertices.agg(F.max("id")).first()[0]
        spark = self.vertices.sparkSession
        return Graph(self.edges, spark.range(0 if top is None else top + 1))

    def written(self) -> Graph:
        """Edges dealt and sorted by source and vertices by id, written: loops join them without another shuffle or sort."""
        if self.out is not None:
            return self
        edges = cut(self.edges)
        out = OutEdges.of(edges)
        return Graph(out.plain if out.hubs is None else edges, cut(self.vertices.repartition("id").sortWithinPartitions("id")), out)
