"""Queries of the graph engine on graphs derived from the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.checkpoints import checkpoint_dir
from strandgraph.functions import degrees as dg
from strandgraph.functions import frontier as fr
from strandgraph.functions.scans import compact, prefix_sum
from strandgraph.graph import Graph
from strandgraph.operators import accounting, traversal
from strandgraph.operators.pagerank import pagerank
from strandgraph.plans.memory import max_subgraph_edges, plan_static_region
from strandgraph.plans.partition import bisected_plan, greedy_plan
from strandgraph.sources.csr import Layout, bel_summary, read_csr, widen, write_bel, write_csr
from strandgraph.sources.tables import customer_part, supplier_part, user_transitions

Query = Callable[[SparkSession, str], DataFrame]
BIG = 100
ROUNDS = 8


def _sp(spark: SparkSession, sf_dir: str) -> Graph:
    return supplier_part(spark, sf_dir).written()


def _source(g: Graph) -> int:
    """The vertex with the most out-edges, the lowest of several."""
    return dg.out_degrees(g).agg(F.min(F.struct((-F.col("out_degree")).alias("d"), "id"))["id"].alias("id")).first()["id"]


def _active(g: Graph) -> DataFrame:
    """Vertices with at least the average degree."""
    mean = F.broadcast(dg.average_degree(g))  # one row
    return dg.out_degrees(g).join(mean, F.col("out_degree") >= F.col("average_degree")).select("id", F.col("out_degree").alias("degree"))


def _cap(g: Graph) -> int:
    return g.edges.count() // 2


def _csr_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir).dense()
    return dg.csr_degrees(dg.csr(g), g.edges.count())


def _next_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.next_big_node(_sp(spark, sf_dir), 1, BIG)


def _region_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir).dense()
    n, e = g.vertices.count(), g.edges.count()
    # memory for a third of the edges beside the vertices, so that the plan isn't trivial
    plan = plan_static_region("bfs", n, e, available=17 * 4 * n + 4 * (e // 3))
    return fr.region_edges(dg.csr(g), plan.cap).select(F.lit(plan.total_edges_that_fit).cast("long").alias("fitting"), F.lit(plan.cap).cast("long").alias("cap"), "static_edges", "ondemand_edges")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return fr.frontier_split(_active(g), fr.static_region(dg.csr(g.dense()), _cap(g)))


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir).dense()
    return fr.static_region(dg.csr(g), _cap(g))


def _sub_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return fr.subgraph_csr(dg.csr(g), _active(g))


def _plan_cap(g: Graph) -> int:
    return max(g.edges.count() // 20, 1)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return traversal.bfs(g, _source(g))


def _cp(spark: SparkSession, sf_dir: str) -> Graph:
    return customer_part(spark, sf_dir, None).written()


def _orders_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _cp(spark, sf_dir)
    return traversal.bfs(g, _source(g)).where("level IS NOT NULL")


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return traversal.sssp(g, _source(g))


def _sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _cp(spark, sf_dir)
    return traversal.with_sentinel(traversal.bfs(g, _source(g)), "level", g.vertices.count() + 1)


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    sources = [r["source"] for r in dg.big_node_sources(g, BIG).collect()]  # five rows
    return traversal.bfs_multi_source(g, sources)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.cc(_cp(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return traversal.bfs_run(g, _source(g), measured=True, cap=_cap(g)).metrics()


def _transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return accounting.data_transport(traversal.bfs_run(g, _source(g), measured=True))


def _sssp_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return accounting.data_transport(traversal.sssp_run(g, _source(g), measured=True))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    run = traversal.bfs_run(g, _source(g), measured=True, cap=_cap(g))
    return accounting.totals(run)


def _sssp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _sp(spark, sf_dir)
    return traversal.sssp_run(g, _source(g), measured=True).metrics()


def _cc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.cc_run(supplier_part(spark, sf_dir), measured=True).metrics()


def _ranks(**options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pagerank(supplier_part(spark, sf_dir), **options).select("id", F.round("rank", 4).alias("rank"))

    return query


def _rank_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes: list[tuple[int, int, int]] = []
    pagerank(supplier_part(spark, sf_dir), sizes=sizes)
    return spark.createDataFrame(sizes, "iteration int, active_vertices long, newly_frozen long")


def _file(spark: SparkSession, name: str = "graph.csr") -> str:
    """A new file's place in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}-{name}"


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they are read back from a weighted CSR file."""
    path = _file(spark)
    write_csr(_sp(spark, sf_dir), path, Layout(weighted=True))
    return read_csr(spark, path, Layout(weighted=True)).edges


def _plain_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark)
    write_csr(user_transitions(spark, sf_dir), path)
    return read_csr(spark, path).edges.select("src", "dst")


def _widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a file with 4-byte header and pointers, after it is rewritten with 8-byte edges."""
    path = _file(spark, "old.bcsr")
    write_csr(user_transitions(spark, sf_dir), path, Layout(header=4))
    return read_csr(spark, widen(path), Layout(header=4, edge_width=8)).edges.select("src", "dst")


def _bel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the three files hold: their two leading numbers and the sum of what follows."""
    names = write_bel(user_transitions(spark, sf_dir), _file(spark, "graph"))
    return spark.createDataFrame([(name.rpartition(".")[2], *bel_summary(name)) for name in names], "file string, size long, zero long, total long")


def _first_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(dg.first_big_node(_sp(spark, sf_dir), BIG),)], "node long")


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per algorithm the edges that fit beside the graph's vertices, and those of a sub-graph processed at once."""
    g = _sp(spark, sf_dir).dense()
    n, e = g.vertices.count(), g.edges.count()
    rows = []
    for algo in ("bfs", "cc", "sssp", "pagerank"):
        plan = plan_static_region(algo, n, e, available=64 * n + 8 * (e // 3))
        rows.append((algo, plan.total_edges_that_fit, plan.cap, max_subgraph_edges(algo, n)))
    return spark.createDataFrame(rows, "algo string, fitting long, cap long, max_subgraph long")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark)
    layout = Layout(out_degree=True, incoming=True)
    write_csr(user_transitions(spark, sf_dir), path, layout)
    return dg.in_degrees(read_csr(spark, path, layout))


def queries() -> dict[str, Query]:
    return {
        "bfs_levels": _levels,
        "bfs_levels_orders": _orders_levels,
        "bfs_reached": lambda s, d: traversal.reached_count(_levels(s, d), "level"),
        "bfs_frontier_sizes": lambda s, d: traversal.frontier_sizes(_levels(s, d)),
        "bfs_multi_source": _multi,
        "bfs_hybrid_sentinel": _sentinel,
        "bfs_metrics": _metrics,
        "sssp_distances": _distances,
        "sssp_reached": lambda s, d: traversal.reached_count(_distances(s, d), "distance"),
        "sssp_metrics": _sssp_metrics,
        "head_tail_sample": lambda s, d: traversal.head_tail_sample(_distances(s, d)),
        "cc_labels": _labels,
        "cc_labels_directed": lambda s, d: traversal.cc(user_transitions(s, d)),
        "cc_count": lambda s, d: traversal.component_count(_labels(s, d)),
        "cc_sizes": lambda s, d: traversal.component_sizes(_labels(s, d)),
        "cc_metrics": _cc_metrics,
        "pagerank_hold_k": _ranks(max_rounds=ROUNDS),
        "pagerank_commit_k": _ranks(max_rounds=ROUNDS, init="1/V", freeze="commit"),
        "pagerank_host_k": _ranks(max_rounds=ROUNDS, init="1/V", freeze="commit", damping=0.15),
        "pagerank_frontier_sizes": _rank_sizes,
        "pagerank_hold": _ranks(),
        "pagerank_commit": _ranks(init="1/V", freeze="commit"),
        "out_degree": lambda s, d: dg.out_degrees(_sp(s, d)),
        "in_degree": lambda s, d: dg.in_degrees(user_transitions(s, d)),
        "csr_degree": _csr_degree,
        "csr_pointers": lambda s, d: dg.csr(_sp(s, d).dense()),
        "max_degree": lambda s, d: dg.max_degree(_sp(s, d)),
        "average_degree": lambda s, d: dg.average_degree(_sp(s, d)),
        "big_node_count": lambda s, d: dg.big_node_count(_sp(s, d)),
        "next_big_node": _next_big,
        "big_node_sources": lambda s, d: dg.big_node_sources(_sp(s, d), BIG),
        "has_reciprocal_edge": lambda s, d: dg.has_reciprocal_edge(user_transitions(s, d)),
        "symmetrize": lambda s, d: user_transitions(s, d).symmetrized().edges,
        "active_count": lambda s, d: fr.active_count(_active(_sp(s, d)).withColumn("active", F.col("degree") % 2 == 0)),
        "active_subgraph": lambda s, d: fr.active_subgraph(g := _sp(s, d), _active(g)),
        "subgraph_csr": _sub_csr,
        "frontier_compact": lambda s, d: compact(_active(_sp(s, d)).select("id")),
        "prefix_sum_exclusive": lambda s, d: prefix_sum(dg.out_degrees(_sp(s, d)), "out_degree", "total", inclusive=False).select("id", "total"),
        "prefix_sum_inclusive": lambda s, d: prefix_sum(dg.out_degrees(_sp(s, d)), "out_degree", "total", inclusive=True).select("id", "total"),
        "static_region": _static,
        "frontier_split": _split,
        "static_region_plan": _region_plan,
        "partition_plan_greedy": lambda s, d: greedy_plan(_active(g := _sp(s, d)), _plan_cap(g)),
        "partition_plan_bisect": lambda s, d: bisected_plan(_active(g := _sp(s, d)), _plan_cap(g)),
        "data_transport": _transport,
        "sssp_data_transport": _sssp_transport,
        "edges_moved": _moved,
        "csr_round_trip": _round_trip,
        "csr_plain_round_trip": _plain_trip,
        "csr_widened": _widened,
        "bel_export": _bel,
        "first_big_node": _first_big,
        "region_budgets": _budgets,
        "csr_incoming_round_trip": _incoming,
    }


# ---------------------------------------------------------------- SQL

_SP = """
e AS (SELECT CAST(l_suppkey * 2 + 1 AS BIGINT) AS src, CAST(l_partkey * 2 AS BIGINT) AS dst, CAST(min(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2)"""
_CP = """
e AS (SELECT CAST(o_custkey * 2 + 1 AS BIGINT) AS src, CAST(l_partkey * 2 AS BIGINT) AS dst, CAST(min(l_quantity) AS BIGINT) AS weight
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
_UT = """
s AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events),
u AS (SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, count(*) AS weight FROM s WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
v AS (SELECT src AS id FROM u UNION SELECT dst FROM u)"""
_SYM = """,
u AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
v AS (SELECT DISTINCT src AS id FROM u)"""
_DEG = """,
d AS MATERIALIZED (SELECT v.id, count(u.src) AS deg FROM v LEFT JOIN u ON u.src = v.id GROUP BY v.id)"""
_DENSE = """,
w AS (SELECT range AS id FROM range((SELECT max(id) + 1 FROM v))),
c AS MATERIALIZED (SELECT id, deg, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr
      FROM (SELECT w.id, count(u.src) AS deg FROM w LEFT JOIN u ON u.src = w.id GROUP BY w.id)),
k AS (SELECT count(*) // 2 AS cap, count(*) AS edges FROM u),
region AS (SELECT id, deg, ptr < cap AND ptr + deg - 1 >= 0 AND ptr + deg - 1 < cap AS is_static FROM c, k)"""
_ACTIVE = """,
a AS MATERIALIZED (SELECT id, deg FROM d WHERE deg >= (SELECT sum(deg) // count(*) FROM d))"""
_ROOT = """,
root AS (SELECT id FROM d ORDER BY deg DESC, id LIMIT 1)"""


def _reach(graph: str, step: str, seed: str = "SELECT id, CAST(1 AS BIGINT) FROM root") -> str:
    """Tables up to x(id, x), a keyed recursion that lowers values until none changes."""
    return f"""WITH RECURSIVE{graph}{_SYM}{_DEG}{_ROOT},
x(id, x) USING KEY (id) AS ({seed} UNION
  SELECT u.dst, min({step}) FROM x JOIN u ON x.id = u.src LEFT JOIN recurring.x AS r ON r.id = u.dst
  WHERE r.x IS NULL OR {step} < r.x GROUP BY u.dst)"""


_LEVELS = _reach(_SP, "x.x + 1")
_DEEP = _reach(_CP, "x.x + 1")
_DISTANCES = _reach(_SP, "x.x + u.weight")
_LABELS = _reach(_CP, "x.x", "SELECT id, id FROM v")


def _rank_sql(init: str, damping: float, commit: bool, result: str = f"SELECT id, round(rank, 4) AS rank FROM r{ROUNDS}") -> str:
    steps = [f"r0 AS MATERIALIZED (SELECT id, CAST({init} AS DOUBLE) AS rank, true AS active FROM v)"]
    for i in range(1, ROUNDS + 1):
        p = f"r{i - 1}"
        on = "p.active AND NOT abs(n.new - p.rank) < 0.001" if commit else "p.active AND abs(n.new - p.rank) > 0.001"
        value = "CASE WHEN p.active THEN n.new ELSE p.rank END" if commit else f"CASE WHEN {on} THEN n.new ELSE p.rank END"
        steps.append(f"""r{i} AS MATERIALIZED (SELECT p.id, {value} AS rank, {on} AS active FROM {p} AS p JOIN (
  SELECT v.id, 0.15::DOUBLE + {damping}::DOUBLE * coalesce(sum(q.rank / d.deg), 0) AS new FROM v LEFT JOIN u ON u.dst = v.id LEFT JOIN {p} AS q ON q.id = u.src LEFT JOIN d ON d.id = u.src GROUP BY v.id) AS n ON n.id = p.id)""")
    return f"WITH {_SP}{_SYM}{_DEG},\n" + ",\n".join(steps) + f"\n{result}"


def _fixpoint_sql(init: str, commit: bool, result: str = " SELECT id, round(rank, 4) AS rank FROM r WHERE i = (SELECT max(i) FROM r)") -> str:
    """All rounds r(i, id, rank, active) until no vertex is active."""
    on = "p.active AND NOT abs(n.new - p.rank) < 0.001" if commit else "p.active AND abs(n.new - p.rank) > 0.001"
    value = "CASE WHEN p.active THEN n.new ELSE p.rank END" if commit else f"CASE WHEN {on} THEN n.new ELSE p.rank END"
    return f"""WITH RECURSIVE{_SP}{_SYM}{_DEG},
r(i, id, rank, active) AS (SELECT CAST(0 AS INTEGER), id, CAST({init} AS DOUBLE), true FROM v UNION ALL
  SELECT p.i + 1, p.id, {value}, {on} FROM r AS p JOIN (
    SELECT u.dst AS id, 0.15::DOUBLE + 0.85::DOUBLE * sum(q.rank / d.deg) AS new FROM r AS q JOIN u ON u.src = q.id JOIN d ON d.id = u.src GROUP BY u.dst) AS n ON n.id = p.id
  WHERE EXISTS (SELECT 1 FROM r WHERE active))
{result}""".replace("\n,", ",")


def _rounds_sql(algo: str, init: str, step: str, width: int, result: str | None = None) -> str:
    """All rounds r(i, id, x, active) of a minimum's way to its fixpoint, and a row for each frontier."""
    result = result or f"'{algo}' AS algo, iteration, active_vertices, active_edges, CAST(0 AS BIGINT) AS static_vertices, active_vertices AS ondemand_vertices, active_edges * {width} AS bytes_moved"
    return f"""WITH RECURSIVE{_SP}{_SYM}{_DEG}{_ROOT},
r(i, id, x, active) AS (SELECT CAST(0 AS INTEGER), id, x, x IS NOT NULL FROM (SELECT id, CAST({init} AS BIGINT) AS x FROM v) UNION ALL
  SELECT p.i + 1, p.id, CASE WHEN n.m IS NOT NULL AND (p.x IS NULL OR n.m < p.x) THEN n.m ELSE p.x END, n.m IS NOT NULL AND (p.x IS NULL OR n.m < p.x)
  FROM r AS p LEFT JOIN (SELECT u.dst AS id, min({step}) AS m FROM r JOIN u ON u.src = r.id WHERE r.active GROUP BY u.dst) AS n ON n.id = p.id
  WHERE EXISTS (SELECT 1 FROM r WHERE active)),
f AS (SELECT r.i AS iteration, count(*) AS active_vertices, CAST(sum(d.deg) AS BIGINT) AS active_edges FROM r JOIN d ON d.id = r.id WHERE r.active GROUP BY r.i)
SELECT {result} FROM f"""


#: One halving a step; a row with an ``until`` is a partition that has come out.
_BISECT = f"""WITH RECURSIVE{_SP}{_SYM}{_DEG}{_ACTIVE},
z AS MATERIALIZED (SELECT (SELECT greatest(count(*) // 20, 1) FROM u) AS cap, (SELECT count(*) FROM a) AS n, (SELECT CAST(sum(deg) AS BIGINT) FROM a) AS total),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, CAST(sum(deg) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM a),
s(part, start, base, lo, hi, found, refine, until, edges) AS (
  SELECT CAST(0 AS INTEGER), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), n, CAST(NULL AS BIGINT), CAST(10 AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM z UNION ALL
  SELECT CASE WHEN t.until IS NULL THEN t.part ELSE t.part + 1 END, CASE WHEN t.until IS NULL THEN t.start ELSE t.until END, CASE WHEN t.until IS NULL THEN t.base ELSE t.base + t.edges END,
         CASE WHEN t.until IS NULL THEN t.lo ELSE t.until END, CASE WHEN t.until IS NULL THEN t.hi ELSE t.n END, CASE WHEN t.until IS NULL THEN t.found END,
         CASE WHEN t.until IS NULL THEN t.refine ELSE CAST(10 AS INTEGER) END, t.until, t.edges
  FROM (SELECT k.part, k.start, k.base, k.n, k.halves, CASE WHEN k.halves AND k.fits THEN k.mid ELSE k.lo END AS lo, CASE WHEN k.halves AND NOT k.fits THEN k.mid ELSE k.hi END AS hi,
               CASE WHEN k.halves AND k.fits THEN k.mid ELSE k.found END AS found, CASE WHEN k.halves AND k.found IS NOT NULL THEN k.refine - 1 ELSE k.refine END AS refine,
               CASE WHEN NOT k.halves THEN k.stop END AS until, CASE WHEN NOT k.halves THEN e.upto - k.base END AS edges
        FROM (SELECT s.*, z.n, (s.lo + s.hi) // 2 AS mid, m.upto - s.base <= z.cap AS fits, z.total - s.base > z.cap AND s.hi - s.lo > 1 AND (s.found IS NULL OR s.refine > 0) AS halves,
                     CASE WHEN z.total - s.base <= z.cap THEN z.n ELSE coalesce(s.found, s.start + 1) END AS stop
              FROM s, z LEFT JOIN p AS m ON m.i = (s.lo + s.hi) // 2 WHERE s.start < z.n) AS k
        LEFT JOIN p AS e ON e.i = k.stop) AS t)
SELECT CAST(part - 1 AS INTEGER) AS part, start - n_vertices AS start_index, n_vertices, edges AS n_edges, base - edges AS from_edge
FROM (SELECT part, start, base, edges, until - lag(until, 1, 0) OVER (ORDER BY until) AS n_vertices FROM s WHERE until IS NOT NULL)"""

_ROUNDS = """,
f AS (SELECT CAST(x - 1 AS INTEGER) AS iteration, count(*) AS n, CAST(sum(region.deg) AS BIGINT) AS e, count(*) FILTER (is_static) AS s,
             CAST(coalesce(sum(region.deg) FILTER (NOT is_static), 0) AS BIGINT) AS o FROM x JOIN region ON region.id = x.id GROUP BY 1)"""


def _fixed(text: str) -> str:
    """The recursion's tables with those of the dense graph after them."""
    return f"{_LEVELS}{_DENSE}{text}"


def oracle_sql() -> dict[str, str]:
    sp, degree = f"WITH {_SP}{_SYM}", f"WITH {_SP}{_SYM}{_DEG}"
    active, dense = f"{degree}{_ACTIVE}", f"{degree}{_DENSE}"
    return {
        "bfs_levels": f"{_LEVELS} SELECT v.id, x.x AS level FROM v LEFT JOIN x ON x.id = v.id",
        "bfs_levels_orders": f"{_DEEP} SELECT id, x AS level FROM x",
        "bfs_reached": f"{_LEVELS} SELECT count(*) AS reached FROM x",
        "bfs_frontier_sizes": f"{_LEVELS} SELECT CAST(x - 1 AS INTEGER) AS iteration, count(*) AS active_vertices FROM x GROUP BY 1",
        "bfs_multi_source": f"""WITH RECURSIVE{_SP}{_SYM}{_DEG},
big AS (SELECT id FROM d WHERE deg > {BIG} AND id > 0 AND id < (SELECT max(id) FROM v) ORDER BY id LIMIT 5),
x(source, id, x) USING KEY (source, id) AS (SELECT id, id, CAST(1 AS BIGINT) FROM big UNION
  SELECT x.source, u.dst, min(x.x + 1) FROM x JOIN u ON x.id = u.src LEFT JOIN recurring.x AS r ON r.id = u.dst AND r.source = x.source
  WHERE r.x IS NULL OR x.x + 1 < r.x GROUP BY x.source, u.dst)
SELECT source, id, x AS level FROM x""",
        "bfs_hybrid_sentinel": f"{_DEEP} SELECT v.id, coalesce(x.x, (SELECT count(*) + 1 FROM v)) AS level FROM v LEFT JOIN x ON x.id = v.id",
        "bfs_metrics": _fixed(f"{_ROUNDS} SELECT 'bfs' AS algo, iteration, n AS active_vertices, e AS active_edges, s AS static_vertices, n - s AS ondemand_vertices, o * 4 AS bytes_moved FROM f"),
        "sssp_distances": f"{_DISTANCES} SELECT v.id, x.x AS distance FROM v LEFT JOIN x ON x.id = v.id",
        "sssp_reached": f"{_DISTANCES} SELECT count(*) AS reached FROM x",
        "head_tail_sample": f"{_DISTANCES}, y AS (SELECT v.id, x.x AS distance FROM v LEFT JOIN x ON x.id = v.id) (SELECT * FROM y ORDER BY id LIMIT 10) UNION ALL (SELECT * FROM y ORDER BY id DESC LIMIT 1)",
        "cc_labels": f"{_LABELS} SELECT id, x AS label FROM x",
        "cc_labels_directed": f"""WITH RECURSIVE{_UT},
x(id, x) USING KEY (id) AS (SELECT id, id FROM v UNION
  SELECT u.dst, min(x.x) FROM x JOIN u ON x.id = u.src LEFT JOIN recurring.x AS r ON r.id = u.dst WHERE x.x < r.x GROUP BY u.dst)
SELECT id, x AS label FROM x""",
        "cc_count": f"{_LABELS} SELECT count(*) AS components FROM x WHERE id = x",
        "cc_sizes": f"{_LABELS} SELECT x AS label, count(*) AS size FROM x GROUP BY x",
        "pagerank_hold_k": _rank_sql("1", 0.85, False),
        "pagerank_commit_k": _rank_sql("1.0::DOUBLE / (SELECT count(*) FROM v)", 0.85, True),
        "pagerank_host_k": _rank_sql("1.0::DOUBLE / (SELECT count(*) FROM v)", 0.15, True),
        "pagerank_frontier_sizes": _fixpoint_sql("1", False, """, n AS (SELECT i, count(*) FILTER (active) AS n FROM r GROUP BY i)
SELECT a.i AS iteration, a.n AS active_vertices, a.n - b.n AS newly_frozen FROM n AS a JOIN n AS b ON b.i = a.i + 1"""),
        "pagerank_hold": _fixpoint_sql("1", False),
        "pagerank_commit": _fixpoint_sql("1.0::DOUBLE / (SELECT count(*) FROM v)", True),
        "sssp_metrics": _rounds_sql("sssp", "CASE WHEN id = (SELECT id FROM root) THEN 1 END", "r.x + u.weight", 8),
        "cc_metrics": _rounds_sql("cc", "id", "r.x", 4),
        "sssp_data_transport": _rounds_sql("sssp", "CASE WHEN id = (SELECT id FROM root) THEN 1 END", "r.x + u.weight", 8, "CAST(sum(active_edges * 8 + active_vertices * 4) AS BIGINT) AS data_transport"),
        "partition_plan_bisect": _BISECT,
        "csr_plain_round_trip": f"WITH {_UT} SELECT src, dst FROM u",
        "csr_widened": f"WITH {_UT} SELECT src, dst FROM u",
        "bel_export": f"""WITH {_UT}, w AS (SELECT range AS id FROM range((SELECT max(id) + 1 FROM v))),
c AS (SELECT id, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr
      FROM (SELECT w.id, count(u.src) AS deg FROM w LEFT JOIN u ON u.src = w.id GROUP BY w.id))
SELECT 'col' AS file, count(*) AS size, CAST(0 AS BIGINT) AS zero, CAST(sum(ptr) AS BIGINT) AS total FROM c
UNION ALL SELECT 'dst', count(*), 0, CAST(sum(dst) AS BIGINT) FROM u UNION ALL SELECT 'val', count(*), 0, CAST(sum(weight) AS BIGINT) FROM u""",
        "first_big_node": f"{degree} SELECT min(id) AS node FROM d WHERE deg > {BIG} AND id < (SELECT max(id) FROM v)",
        "out_degree": f"{degree} SELECT id, deg AS out_degree FROM d",
        "in_degree": f"WITH {_UT} SELECT v.id, count(u.dst) AS in_degree FROM v LEFT JOIN u ON u.dst = v.id GROUP BY v.id",
        "csr_degree": f"{dense} SELECT id, deg AS degree FROM c",
        "csr_pointers": f"{dense} SELECT id, ptr, deg AS degree FROM c",
        "max_degree": f"{degree} SELECT max(deg) AS max_degree FROM d",
        "average_degree": f"{degree} SELECT CAST(sum(deg) // count(*) AS BIGINT) AS average_degree FROM d",
        "big_node_count": f"{degree} SELECT count(*) FILTER (deg >= 32) AS big_nodes FROM d",
        "next_big_node": f"{degree} SELECT coalesce(min(id), 1) AS node FROM d WHERE deg > {BIG} AND id > 1 AND id < (SELECT max(id) FROM v)",
        "big_node_sources": f"""{degree}, b AS (SELECT id FROM d WHERE deg > {BIG} AND id > 0 AND id < (SELECT max(id) FROM v) ORDER BY id LIMIT 5),
q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM b)
SELECT CAST(r.range AS INTEGER) AS run, coalesce(q.id, (SELECT max(id) FROM q), 0) AS source FROM range(5) AS r LEFT JOIN q ON q.p = r.range""",
        "has_reciprocal_edge": f"WITH {_UT} SELECT count(*) > 0 AS reciprocal FROM u JOIN u AS b ON u.src = b.dst AND u.dst = b.src",
        "symmetrize": f"WITH {_UT} SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM u UNION ALL SELECT dst, src, weight FROM u) GROUP BY src, dst",
        "active_count": f"{active} SELECT count(*) FILTER (deg % 2 = 0) AS active_vertices FROM a",
        "active_subgraph": f"{active} SELECT src, dst, weight FROM u JOIN a ON a.id = u.src",
        "subgraph_csr": f"{active} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr, deg AS degree FROM a",
        "frontier_compact": f"{active} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM a",
        "prefix_sum_exclusive": f"{degree} SELECT id, CAST(coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM d",
        "prefix_sum_inclusive": f"{degree} SELECT id, CAST(sum(deg) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d",
        "static_region": f"{dense} SELECT id, is_static FROM region",
        "frontier_split": f"{active}{_DENSE} SELECT a.id, CASE WHEN is_static THEN 'static' ELSE 'ondemand' END AS part FROM a JOIN region ON region.id = a.id",
        "static_region_plan": f"""{dense}, t AS (SELECT edges // 3 AS fitting, edges FROM k),
h AS (SELECT *, (10 - edges / fitting) / 9 AS share FROM t),
g AS (SELECT *, least(CAST(floor(CASE WHEN share < 0 THEN 0.5 WHEN share > 1 THEN 1 ELSE share END * fitting) AS BIGINT), edges) AS top FROM h)
SELECT fitting, top AS cap, CAST(coalesce(sum(deg) FILTER (ptr < top AND ptr + deg - 1 >= 0 AND ptr + deg - 1 < top), 0) AS BIGINT) AS static_edges,
       CAST(edges - coalesce(sum(deg) FILTER (ptr < top AND ptr + deg - 1 >= 0 AND ptr + deg - 1 < top), 0) AS BIGINT) AS ondemand_edges
FROM c, g GROUP BY fitting, top, edges""",
        "partition_plan_greedy": f"""WITH RECURSIVE{_SP}{_SYM}{_DEG}{_ACTIVE},
z AS (SELECT greatest(count(*) // 20, 1) AS cap FROM u),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS i, CAST(sum(deg) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, deg FROM a),
n AS MATERIALIZED (SELECT p.i, p.upto - p.deg AS base, max(coalesce(q.i, p.i)) + 1 AS stop FROM p CROSS JOIN z LEFT JOIN p AS q ON q.i >= p.i AND q.upto <= p.upto - p.deg + z.cap GROUP BY p.i, p.upto, p.deg),
r AS (SELECT 0 AS part, CAST(0 AS BIGINT) AS i UNION ALL SELECT r.part + 1, n.stop FROM r JOIN n ON n.i = r.i WHERE n.stop < (SELECT count(*) FROM p))
SELECT CAST(r.part AS INTEGER) AS part, r.i AS start_index, n.stop - r.i AS n_vertices, p.upto - n.base AS n_edges, n.base AS from_edge
FROM r JOIN n ON n.i = r.i JOIN p ON p.i = n.stop - 1""",
        "data_transport": _fixed(f"{_ROUNDS} SELECT CAST(sum(e * 8 + n * 4) AS BIGINT) AS data_transport FROM f"),
        "edges_moved": _fixed(f"{_ROUNDS} SELECT CAST(sum(n) AS BIGINT) AS sum_active_vertices, CAST(sum(e) AS BIGINT) AS sum_active_edges, CAST(sum(s) AS BIGINT) AS sum_static_vertices, CAST(sum(n - s) AS BIGINT) AS sum_ondemand_vertices, CAST(sum(o * 4) AS BIGINT) AS sum_bytes_moved FROM f"),
        "csr_round_trip": f"{sp} SELECT src, dst, weight FROM u",
        "csr_incoming_round_trip": f"WITH {_UT} SELECT range AS id, count(u.dst) AS in_degree FROM range((SELECT max(id) + 1 FROM v)) LEFT JOIN u ON u.dst = range GROUP BY range",
    }
