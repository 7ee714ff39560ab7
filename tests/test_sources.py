import numpy as np
import pytest

from strandgraph.__main__ import main
from strandgraph.graph import Graph
from strandgraph.sources.csr import Layout, read_csr, read_header, stored_out_degrees, widen, write_bel, write_csr
from strandgraph.sources.report import Timer, append_metrics
from strandgraph.sources.tables import edge_list
from strandgraph.streaming.degrees import streaming_out_degrees

EDGES = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (3, 3, 7), (0, 1, 9)]


@pytest.fixture
def g(spark):
    return Graph.from_edges(spark.createDataFrame(EDGES, "src long, dst long, weight long"), spark.range(6))


@pytest.mark.parametrize("layout", [Layout(), Layout(weighted=True), Layout(out_degree=True, incoming=True), Layout(header=4), Layout(header=4, edge_width=8)])
def test_round_trip(spark, g, tmp_path, layout):
    path = str(tmp_path / "g.csr")
    write_csr(g, path, layout)
    assert read_header(path, layout) == (6, 5)
    for split in (1 << 20, 8):
        back = read_csr(spark, path, layout, split)
        expected = sorted((a, b, w if layout.weighted else 1) for a, b, w in EDGES)
        assert sorted(map(tuple, back.edges.collect())) == expected
        assert back.vertices.count() == 6
    if layout.out_degree:
        assert stored_out_degrees(path).tolist() == [3, 0, 1, 1, 0, 0]


def test_bad_files(spark, g, tmp_path):
    path = tmp_path / "g.csr"
    write_csr(g, str(path))
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError):
        read_csr(spark, str(path))
    with pytest.raises(FileNotFoundError):
        read_csr(spark, str(tmp_path / "none"))


def test_widen_and_bel(g, tmp_path):
    path = str(tmp_path / "g.wcsr")
    write_csr(g, path, Layout(header=4))
    out = widen(path)
    assert out.endswith("g.lcsr") and read_header(out, Layout(header=4, edge_width=8)) == (6, 5)
    col, dst, val = (np.fromfile(p, d) for p, d in zip(write_bel(g, str(tmp_path / "g")), ("<u8", "<u8", "u1"), strict=True))
    assert col.tolist() == [6, 0, 0, 3, 3, 4, 5, 5] and dst.tolist() == [5, 0, 1, 1, 2, 1, 3]
    assert val[:16].view("<u8").tolist() == [5, 0] and val[16:].view("<u4").tolist() == [4, 9, 1, 2, 7]


def test_edge_list(spark, tmp_path):
    p = tmp_path / "e.tsv"
    p.write_text("# comment\n0\t1\n1\t2\n")
    assert sorted(map(tuple, edge_list(spark, str(p)).edges.collect())) == [(0, 1, 1), (1, 2, 1)]


def test_command_line(spark, g, tmp_path):
    path = str(tmp_path / "g.csr")
    write_csr(g, path)
    rows = main(["-f", path, "--type", "bfs", "-r", "0", "--adviseK", "0.8", "--metrics", str(tmp_path / "m"), "--output", str(tmp_path / "o")], spark)
    assert sorted(map(tuple, rows.collect()))[:3] == [(0, 1), (1, 2), (2, 2)]
    assert spark.read.json(str(tmp_path / "m")).count() == 2 and spark.read.parquet(str(tmp_path / "o")).count() == 6
    ranked = str(tmp_path / "p.csr")
    write_csr(g, ranked, Layout(out_degree=True, incoming=True))
    main(["-f", ranked, "--type", "pr", "--metrics", str(tmp_path / "pm")], spark)
    first = spark.read.json(str(tmp_path / "pm")).where("iteration = 0").first()
    assert first["algo"] == "pagerank" and first["active_vertices"] == 6
    for bad in (["-f", path, "--method", "1"], ["-f", path, "--type", "mst"]):
        with pytest.raises(SystemExit):
            main(bad, spark)
    with pytest.raises(ValueError):
        main(["-f", path, "-r", "99"], spark)


def test_timer_and_report(spark, tmp_path):
    t = Timer()
    with t.span("a"):
        pass
    assert t.seconds["a"] >= 0
    append_metrics(spark.range(2), str(tmp_path / "m"))
    append_metrics(spark.range(3), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 5


def test_streaming_degrees(spark, g, tmp_path):
    g.edges.coalesce(1).write.parquet(str(tmp_path / "edges"))
    stream = spark.readStream.schema(g.edges.schema).parquet(str(tmp_path / "edges"))
    q = streaming_out_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == [(0, 3), (2, 1), (3, 1)]
