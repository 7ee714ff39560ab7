"""The fixpoint loop: expand the frontier, combine candidates by target, keep what improves.

Rounds are Jacobi: all candidates of a round come from the values before it, so
results and frontiers don't depend on the order of edges.  Edges stay hashed by
source, those of hubs by source and part, and the state by id; a round moves only
candidates, combined by target before they are shuffled.  Lineage is cut every ``rounds_per_cut`` rounds; a round
too many changes nothing, so one action serves several rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.checkpoints import cut
from strandgraph.graph import OutEdges

METRICS = "algo string, iteration int, active_vertices long, active_edges long, static_vertices long, ondemand_vertices long, bytes_moved long"


@dataclass
class Run:
    """The last state (key..., id, value, active) and, if asked for, a row of measures for each round."""

    state: DataFrame
    rounds: list[tuple] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        return self.state.sparkSession.createDataFrame(self.rounds, METRICS)


def iterate(
    state: DataFrame,
    edges: OutEdges,
    message: Callable[[Column, Column], Column],
    combine: Callable[[Column], Column] = F.min,
    improves: Callable[[Column, Column], Column] = lambda new, old: old.isNull() | (new < old),
    keys: tuple[str, ...] = (),
    max_rounds: int | None = None,
    rounds_per_cut: int = 2,
    algo: str = "",
    region: DataFrame | None = None,
    edge_bytes: int = 4,
    measured: bool = False,
    sparse: bool = False,
) -> Run:
    """Run ``state`` (keys..., id, value, active) to its fixpoint over ``edges`` (src, dst, weight).

    ``message`` makes a candidate from a value and a weight, ``combine`` one of a
    target's candidates, ``improves`` decides.  ``keys`` separate independent runs in one loop.  A ``sparse``
    state holds only what has a value and grows as the frontier goes on.  With
    ``measured`` each round is cut and measured; ``region`` is (id, degree, is_static).
    """
    run, done = Run(cut(state)), 0
    by = [*keys, "id"]
    while True:
        if measured:
            if not _measure(run, done, algo, region, edge_bytes):
                return run
        elif run.state.where("active").isEmpty():
            return run
        if max_rounds is not None and done >= max_rounds:
            return run
        steps = 1 if measured else rounds_per_cut if max_rounds is None else min(rounds_per_cut, max_rounds - done)
        now = run.state
        for _ in range(steps):
            front = now.where("active").select(*keys, F.col("id").alias("src"), F.col("value").alias("from"))
            sent = edges.sent(front).select(*keys, F.col("dst").alias("id"), message(F.col("from"), F.col("weight")).alias("m"))
            best = sent.groupBy(*by).agg(combine(F.col("m")).alias("m"))
            joined = now.join(best, by, "full_outer" if sparse else "left")
            better = F.col("m").isNotNull() & improves(F.col("m"), F.col("value"))
            now = joined.select(*by, F.when(better, F.col("m")).otherwise(F.col("value")).alias("value"), F.coalesce(better, F.lit(False)).alias("active"))
        run.state = cut(now)
        done += steps


def _measure(run: Run, done: int, algo: str, region: DataFrame | None, edge_bytes: int) -> int:
    front = run.state.where("active").select("id")
    if region is not None:
        front = front.join(region, "id", "left")
        degree, static = F.coalesce("degree", F.lit(0)), F.coalesce("is_static", F.lit(False))
    else:
        degree, static = F.lit(0), F.lit(False)
    r = front.agg(F.count(F.lit(1)).alias("n"), F.sum(degree).alias("e"), F.count_if(static).alias("s"), F.sum(F.when(static, 0).otherwise(degree)).alias("o")).first()
    if r["n"]:
        run.rounds.append((algo, done, r["n"], r["e"] or 0, r["s"], r["n"] - r["s"], (r["o"] or 0) * edge_bytes))
    return r["n"]
