import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandgraph.functions import degrees as dg
from strandgraph.functions import frontier as fr
from strandgraph.functions.scans import compact, prefix_sum
from strandgraph.graph import Graph
from strandgraph.plans.memory import max_subgraph_edges, plan_static_region, reserved_bytes
from strandgraph.plans.partition import bisected_end, bisected_plan, greedy_plan


def graph(spark, n, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.range(n))


def test_prefix_sums_cross_blocks(spark):
    df = spark.range(0, 100, 3).selectExpr("id", "id % 5 AS x")
    rows = prefix_sum(df, "x", "s", inclusive=False, block=8).orderBy("id").collect()
    total = 0
    for r in rows:
        assert r["s"] == total
        total += r["x"]
    assert [r["s"] for r in prefix_sum(df, "x", "s", inclusive=True, block=8).orderBy("id").collect()] == list(np.cumsum([r["x"] for r in rows]))
    assert [r["position"] for r in compact(df.select("id"), block=8).orderBy("id").collect()] == list(range(34))


def test_degrees(spark):
    g = graph(spark, 5, [(0, 1), (0, 2), (2, 2), (3, 0)])
    rows = dg.csr(g)
    assert sorted(map(tuple, rows.collect())) == [(0, 0, 2), (1, 2, 0), (2, 2, 1), (3, 3, 1), (4, 4, 0)]
    assert sorted(map(tuple, dg.csr_degrees(rows, 4, block=2).collect())) == [(0, 2), (1, 0), (2, 1), (3, 1), (4, 0)]
    assert dg.max_degree(g).first()[0] == 2 and dg.average_degree(g).first()[0] == 0
    assert dg.big_node_count(g, 1).first()[0] == 3
    assert dg.next_big_node(g, 0, 0).first()[0] == 2 and dg.next_big_node(g, 3, 0).first()[0] == 3
    assert [r["source"] for r in dg.big_node_sources(g, 0).orderBy("run").collect()] == [2, 3, 3, 3, 3]
    assert [r["source"] for r in dg.big_node_sources(g, 9).orderBy("run").collect()] == [0] * 5
    assert dg.first_big_node(g, 1) == 0
    with pytest.raises(ValueError):
        dg.first_big_node(g, 9)
    assert dg.has_reciprocal_edge(g).first()[0] and not dg.has_reciprocal_edge(graph(spark, 3, [(0, 1), (1, 2)])).first()[0]


def test_residency_edges(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 3), (2, 3, 2), (3, 5, 0), (4, 5, 1)], "id long, ptr long, degree long")
    assert [r["is_static"] for r in fr.static_region(rows, 5).orderBy("id").collect()] == [False, True, True, False, False]
    assert tuple(fr.region_edges(rows, 5).first()) == (5, 1)
    sub = fr.subgraph_csr(rows, spark.createDataFrame([(1,), (4,)], "id long"))
    assert sorted(map(tuple, sub.collect())) == [(1, 0, 0, 3), (4, 1, 3, 1)]


def plan(df):
    return [tuple(r)[1:4] for r in df.orderBy("part").collect()]


def test_partition_plans(spark):
    active = spark.createDataFrame(list(enumerate([3, 1, 4, 1, 5])), "id long, degree long")
    assert plan(greedy_plan(active, 5)) == plan(bisected_plan(active, 5)) == [(0, 2, 4), (2, 2, 5), (4, 1, 5)]
    large = spark.createDataFrame(list(enumerate([2, 9, 1])), "id long, degree long")
    assert plan(greedy_plan(large, 5)) == plan(bisected_plan(large, 5)) == [(0, 1, 2), (1, 1, 9), (2, 1, 1)]
    assert plan(greedy_plan(active.limit(0), 5)) == plan(bisected_plan(active.limit(0), 5)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 30), st.integers(0, 10))
def test_bisected_end_fits(degrees, cap, refine):
    upto = np.cumsum(degrees)
    end = bisected_end(upto, 0, 0, cap, refine)
    assert end >= 1 and (upto[end - 1] <= cap or end == 1)
    if refine >= 8:
        assert end == max(int(np.searchsorted(upto, cap, side="right")), 1)


def test_region_plan():
    assert plan_static_region("bfs", 1000, 10**6).cap == 10**6
    assert plan_static_region("bfs", 0, 10**12).share == 0.5
    assert plan_static_region("bfs", 0, 10, rate=0.8, available=40).cap == 8
    assert plan_static_region("sssp", 10, 9 * 10, available=reserved_bytes("sssp", 10) + 8 * 90).share == 1.0
    assert reserved_bytes("sssp", 10) == 17 * 4 * 10 + 80 and reserved_bytes("pagerank", 10) == 15 * 4 * 10 + 160
    assert max_subgraph_edges("cc", 0) == int(0.9 * 12 * 2**30 / 4) and max_subgraph_edges("pagerank", 0) == int(0.75 * 10 * 2**30 / 4)
    with pytest.raises(ValueError):
        plan_static_region("mst", 1, 1)
