"""Command line: ``python -m strandgraph -f FILE --type bfs -r SOURCE``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from strandgraph.operators import pagerank as pr
from strandgraph.operators import traversal as t
from strandgraph.plans.memory import plan_static_region
from strandgraph.sources.csr import Layout, read_csr, read_header
from strandgraph.sources.report import append_metrics

ALGORITHMS = ("bfs", "sssp", "cc", "pagerank")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandgraph", description="Iterative analytics on a graph in a CSR file", allow_abbrev=False)
    p.add_argument("-f", "--file", required=True, help="CSR file: weighted for sssp; for pagerank, in-edges with out-degrees")
    p.add_argument("--type", "-type", dest="algorithm", type=str.lower, choices=(*ALGORITHMS, "pr"), default="bfs")
    p.add_argument("-r", "--source", type=int, default=0, help="source vertex of bfs and sssp")
    p.add_argument("--adviseK", "--advisek", "-adviseK", dest="rate", type=float, default=0.0, help="share of the edges to keep resident; 0 plans it")
    p.add_argument("--freeze", choices=("hold", "commit"), default="hold", help="what a vertex of pagerank keeps when it comes to rest")
    p.add_argument("--output", help="folder for the result as Parquet")
    p.add_argument("--metrics", help="folder to which rows of measures are added as JSON")
    return p


def layout_of(algorithm: str) -> Layout:
    return {"sssp": Layout(weighted=True), "pagerank": Layout(out_degree=True, incoming=True)}.get(algorithm, Layout())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(args)
    algorithm = "pagerank" if a.algorithm == "pr" else a.algorithm
    spark = spark or SparkSession.builder.appName("strandgraph").getOrCreate()
    layout = layout_of(algorithm)
    n, e = read_header(a.file, layout)
    if algorithm in ("bfs", "sssp") and not 0 <= a.source < n:
        raise ValueError(f"the file has vertices 0 to {n - 1}, not {a.source}")
    g, cap = read_csr(spark, a.file, layout), plan_static_region(algorithm, n, e, a.rate).cap
    if algorithm == "pagerank":
        sizes: list[tuple[int, int, int]] | None = [] if a.metrics else None
        result = pr.pagerank(g, freeze=a.freeze, init=1.0 if a.freeze == "hold" else "1/V", sizes=sizes)
        measures = spark.createDataFrame([(algorithm, *row) for row in sizes or []], pr.METRICS)
    else:
        measured = bool(a.metrics)
        run = t.cc_run(g, measured, cap) if algorithm == "cc" else (t.bfs_run if algorithm == "bfs" else t.sssp_run)(g, a.source, measured, cap)
        name = {"bfs": "level", "sssp": "distance", "cc": "label"}[algorithm]
        result, measures = run.state.select("id", run.state["value"].alias(name)), run.metrics()
    if a.output:
        result.write.mode("overwrite").parquet(a.output)
    if a.metrics:
        append_metrics(measures, a.metrics)
    t.head_tail_sample(result).show()
    return result


if __name__ == "__main__":
    main()
