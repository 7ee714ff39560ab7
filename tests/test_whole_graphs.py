"""Queries over whole tables against brute force."""

from collections import Counter, defaultdict, deque

import duckdb
import pytest

from strandgraph.plans import registry

SF = "/root/testdata/sf0.001"


def neighbours(sql):
    out = defaultdict(set)
    for a, b in duckdb.execute(sql).fetchall():
        out[a].add(b)
        out[b].add(a)
    return out


def reach(of, source):
    level, left = {source: 1}, deque([source])
    while left:
        x = left.popleft()
        for y in of[x]:
            if y not in level:
                level[y] = level[x] + 1
                left.append(y)
    return level


@pytest.fixture(scope="module")
def orders():
    """All customers and parts of the tables, whatever was ordered."""
    return neighbours(f"SELECT DISTINCT o_custkey * 2 + 1, l_partkey * 2 FROM '{SF}/orders.parquet' JOIN '{SF}/lineitem.parquet' ON o_orderkey = l_orderkey")


def run(spark, name):
    return registry.queries()[name](spark, SF)


def test_components_of_all_orders(spark, orders):
    label = {}
    for x in sorted(orders):
        if x not in label:
            label |= dict.fromkeys(reach(orders, x), x)
    assert {r["id"]: r["label"] for r in run(spark, "cc_labels").collect()} == label
    assert run(spark, "cc_count").first()["components"] == len(set(label.values()))
    assert {r["label"]: r["size"] for r in run(spark, "cc_sizes").collect()} == Counter(label.values())


def test_levels_of_all_orders(spark, orders):
    level = reach(orders, min(orders, key=lambda x: (-len(orders[x]), x)))
    assert {r["id"]: r["level"] for r in run(spark, "bfs_levels_orders").collect()} == level
    assert {r["id"]: r["level"] for r in run(spark, "bfs_hybrid_sentinel").collect()} == {x: level.get(x, len(orders) + 1) for x in orders}


def test_frontier_sizes_to_the_end(spark):
    of = neighbours(f"SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM '{SF}/lineitem.parquet'")
    rank, active, expected = dict.fromkeys(of, 1.0), set(of), []
    while active:
        new = {x: 0.15 + 0.85 * sum(rank[y] / len(of[y]) for y in of[x]) for x in active}
        on = {x for x in active if abs(new[x] - rank[x]) > 1e-3}
        expected.append((len(expected), len(active), len(active) - len(on)))
        rank |= {x: new[x] for x in on}
        active = on
    got = sorted(map(tuple, run(spark, "pagerank_frontier_sizes").collect()))
    assert got == expected and len(got) > registry.ROUNDS and got[-1][1] == got[-1][2]
