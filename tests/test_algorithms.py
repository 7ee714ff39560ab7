"""Toy graphs with values worked out beforehand, and properties on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from strandgraph.graph import Graph
from strandgraph.operators import accounting, traversal
from strandgraph.operators.pagerank import pagerank

INF = traversal.INFINITY
T1 = (8, [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 5), (3, 4, 3), (5, 6, 1), (6, 5, 1)])
T2 = (3, [(0, 0, 1), (0, 1, 5), (0, 1, 2), (1, 2, 1)])


def graph(spark, n, edges):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight long"), spark.range(n))


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_bfs(spark):
    g = graph(spark, *T1)
    levels = traversal.bfs(g, 0)
    assert values(traversal.with_sentinel(levels, "level", INF), "level") == [1, 2, 2, 3, 4, INF, INF, INF]
    assert values(traversal.with_sentinel(levels, "level", 9), "level")[5:] == [9, 9, 9]
    assert sorted(map(tuple, traversal.frontier_sizes(levels).collect())) == [(0, 1), (1, 2), (2, 1), (3, 1)]
    assert values(traversal.bfs(graph(spark, *T2), 0), "level") == [1, 2, 3]


def test_sssp(spark):
    g = graph(spark, *T1)
    assert values(traversal.sssp(g, 0), "distance") == [1, 4, 2, 9, 12, None, None, None]
    assert [r[2] for r in traversal.sssp_run(g, 0, measured=True).rounds] == [1, 2, 2, 2, 1]
    assert values(traversal.sssp(graph(spark, *T2), 0), "distance") == [1, 3, 4]


def test_cc(spark):
    g = graph(spark, *T1)
    for x in (g, g.symmetrized()):
        labels = traversal.cc(x)
        assert values(labels, "label") == [0, 0, 0, 0, 0, 5, 5, 7]
        assert traversal.component_count(labels).first()[0] == 3
        assert [r[2] for r in traversal.cc_run(x, measured=True).rounds] == [8, 5, 2, 1]
    assert values(traversal.cc(graph(spark, *T2)), "label") == [0, 0, 0]
    assert sorted(map(tuple, traversal.component_sizes(traversal.cc(g)).collect())) == [(0, 5), (5, 2), (7, 1)]


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, [0.15, 0.3954375, 0.21375, 1.0, 1.0, 1.0, 1.0, 0.15]),
        ({"freeze": "commit", "init": "1/V"}, [0.15, 0.3954375, 0.21375, 0.48612188, 0.56320359, 0.99517593, 0.99517593, 0.15]),
        ({"freeze": "commit", "init": "1/V", "damping": 0.15}, [0.15, 0.1854375, 0.16125, 0.17781563, 0.17666602, 0.17629687, 0.17629687, 0.15]),
    ],
)
def test_pagerank(spark, options, expected):
    assert values(pagerank(graph(spark, *T1), **options), "rank") == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize(("rounds", "expected"), [(1, (0.43333333, 0.71666667, 1.0)), (3, (0.22728704, 0.30457407, 1.0)), (None, (0.20971139, 0.26942279, 1.0))])
def test_pagerank_counts_parallel_edges(spark, rounds, expected):
    assert values(pagerank(graph(spark, *T2), max_rounds=rounds), "rank") == pytest.approx(expected, abs=1e-7)


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        pagerank(graph(spark, *T2), freeze="melt")


def test_multi_source_agrees_with_single_runs(spark):
    g = graph(spark, *T1)
    both = traversal.bfs_multi_source(g, [0, 5, 0]).collect()
    for s in (0, 5):
        single = {(r["id"], r["level"]) for r in traversal.bfs(g, s).collect() if r["level"]}
        assert {(r["id"], r["level"]) for r in both if r["source"] == s} == single


def test_random_graph_fixpoints(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40), r.randrange(1, 9)) for _ in range(70)]
    g = graph(spark, 40, edges)
    level, distance, label = (dict(map(tuple, x.select("id", c).collect())) for x, c in ((traversal.bfs(g, edges[0][0]), "level"), (traversal.sssp(g, edges[0][0]), "distance"), (traversal.cc(g), "label")))
    for a, b, w in edges:
        if distance[a] is not None:
            assert distance[b] <= distance[a] + w
            assert level[b] <= level[a] + 1 and level[b] <= distance[b]
        assert label[b] <= label[a] <= a
    assert all(label[label[v]] == label[v] for v in label)
    assert all(x["rank"] >= 0.15 - 1e-12 for x in pagerank(g).collect())


def test_measures(spark):
    g = graph(spark, *T1)
    run = traversal.bfs_run(g, 0, measured=True, cap=3)
    assert [tuple(r)[:6] for r in run.rounds] == [("bfs", 0, 1, 2, 1, 0), ("bfs", 1, 2, 2, 1, 1), ("bfs", 2, 1, 1, 0, 1), ("bfs", 3, 1, 0, 0, 1)]
    assert accounting.totals(run).first()["sum_bytes_moved"] == 4 * (0 + 1 + 1 + 0)
    assert accounting.data_transport(run).first()[0] == 8 * 5 + 4 * 5


def test_empty_graph(spark):
    g = graph(spark, 0, [])
    assert traversal.bfs(g, 0).count() == traversal.cc(g).count() == pagerank(g).count() == 0
    alone = graph(spark, 2, [])
    assert values(traversal.cc(alone), "label") == [0, 1]


def test_partitions_make_no_difference(spark):
    edges = spark.createDataFrame(T1[1], "src long, dst long, weight long")
    for n in (1, 7):
        assert values(traversal.sssp(Graph.from_edges(edges.repartition(n), spark.range(8)), 0), "distance") == [1, 4, 2, 9, 12, None, None, None]


def test_hubs_make_no_difference(spark, monkeypatch):
    """A vertex with most of the edges, some of them many times, is dealt in parts."""
    rows = [(0, i % 40 + 1, i % 7 + 1) for i in range(300)] + [(i, i + 1, 1) for i in range(1, 44)] + [(i, 0, 2) for i in range(1, 40)]
    g = graph(spark, 45, rows)
    found = []
    for hub in (1 << 22, 350, 16):
        monkeypatch.setattr("strandgraph.graph.HUB", hub)
        out = g.written().out
        assert (out.hubs is None) == (hub > 300)
        every = [tuple(r) for r in out.plain.select("src", "dst", "weight").collect()]
        if out.hubs is not None:
            assert [tuple(r) for r in out.hubs.collect()] == [(0, 19)]
            assert max(r["count"] for r in out.of_hubs.groupBy("part").count().collect()) < 60
            every += [tuple(r) for r in out.of_hubs.select("src", "dst", "weight").collect()]
        assert sorted(every) == sorted(rows)
        results = [traversal.bfs(g, 5), traversal.sssp(g, 5), traversal.cc(g), traversal.bfs_multi_source(g, [0, 7])]
        results.append(pagerank(g, max_rounds=6).select("id", F.round("rank", 9)))
        found.append([sorted(map(tuple, x.collect()), key=str) for x in results])
    assert found[0] == found[1] == found[2]
