"""PageRank with a vertex at a time coming to rest.

Ranks aren't normalized and the rank of vertices without out-edges is dropped.
A vertex whose rank changes by no more than the tolerance is frozen and never
computed again, even if its neighbours change; whether it takes the last value
(``commit``) or stays at the one before (``hold``) is a choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.checkpoints import cut
from strandgraph.functions.degrees import out_degrees
from strandgraph.graph import Graph, OutEdges

METRICS = "algo string, iteration int, active_vertices long, newly_frozen long"


def pagerank(g: Graph, init: str | float = 1.0, damping: float = 0.85, base: float = 0.15, tol: float = 1e-3, freeze: str = "hold", max_rounds: int | None = None, rounds_per_cut: int = 3, sizes: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(id, rank, active).  ``init``: a number, or '1/V'.  Parallel edges count as often as they are.

    Each round all sums come from the ranks before it.  Contributions are summed
    by target before they are shuffled; edges carry their source's degree, and those into
    frozen vertices are left out each time that half of the active vertices are gone.  A
    list in ``sizes`` gets (iteration, active vertices, of these frozen in it) of each round, at an action a round.
    """
    if freeze not in ("hold", "commit"):
        raise ValueError("freeze is 'hold' or 'commit'")
    degrees = out_degrees(g).where("out_degree > 0").select(F.col("id").alias("src"), F.col("out_degree").cast("double").alias("od"))
    edges = OutEdges.of(cut(g.edges.select("src", "dst").join(degrees, "src")))
    n = g.vertices.count()
    start = F.lit(1.0) / F.lit(float(max(n, 1))) if init == "1/V" else F.lit(float(init))
    state = cut(g.vertices.repartition("id").select("id", start.alias("rank"), F.lit(True).alias("active")))
    done, left, held = 0, n, n
    while left and (max_rounds is None or done < max_rounds):
        steps = 1 if sizes is not None else rounds_per_cut if max_rounds is None else min(rounds_per_cut, max_rounds - done)
        now = state
        for _ in range(steps):
            sent = edges.sent(now.select(F.col("id").alias("src"), "rank")).select(F.col("dst").alias("id"), (F.col("rank") / F.col("od")).alias("c"))
            sums = sent.groupBy("id").agg(F.sum("c").alias("s"))
            new = F.lit(base) + F.lit(damping) * F.coalesce("s", F.lit(0.0))
            step = now.join(sums, "id", "left").withColumn("new", new).withColumn("diff", F.abs(F.col("new") - F.col("rank")))
            if freeze == "hold":
                on = F.col("active") & (F.col("diff") > tol)
                value = F.when(on, F.col("new")).otherwise(F.col("rank"))
            else:
                on = F.col("active") & ~(F.col("diff") < tol)
                value = F.when(F.col("active"), F.col("new")).otherwise(F.col("rank"))
            now = step.select("id", value.alias("rank"), on.alias("active"))
        state, done = cut(now), done + steps
        before, left = left, state.where("active").count()
        if sizes is not None:
            sizes.append((done - 1, before, before - left))
        if 0 < 2 * left <= held:
            edges, held = edges.only(_hinted(state.where("active").select(F.col("id").alias("dst")), left)), left
    return state


#: Rows of ids that are broadcast, at most.
BROADCAST_IDS = 500_000


def _hinted(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, of which there are ``n``, with a broadcast hint if they are few: edges then stay where they are, else they are hashed by source anew."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids
