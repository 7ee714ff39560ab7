"""Binary compressed-sparse-row files: a Spark data source, and writers.

Layouts, all little-endian: a header with the numbers of vertices and edges,
perhaps the out-degree of each vertex (u32), a pointer for each vertex, the
edges.  Header and pointers are 8 bytes wide, or 4 in the old form; an edge is a
vertex (4 bytes, or 8) and perhaps a weight (4).  There is no pointer past the
last vertex; its edges end with the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandgraph.checkpoints import cut
from strandgraph.functions.degrees import csr
from strandgraph.graph import Graph

#: Bytes of edges that a task reads.
SPLIT = 64 << 20


@dataclass(frozen=True)
class Layout:
    weighted: bool = False
    out_degree: bool = False
    incoming: bool = False  # edges are listed by target and name their source
    header: int = 8
    edge_width: int = 4

    @property
    def edge_type(self) -> np.dtype:
        fields = [("v", f"<u{self.edge_width}")] + ([("w", "<u4")] if self.weighted else [])
        return np.dtype(fields)

    def starts(self, n: int) -> tuple[int, int]:
        """Offsets of pointers and of edges."""
        pointers = 2 * self.header + (4 * n if self.out_degree else 0)
        return pointers, pointers + self.header * n

    def bytes(self, n: int, e: int) -> int:
        return self.starts(n)[1] + e * self.edge_type.itemsize


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and its name there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class _Out:
    """A file to write, wherever it is."""

    def __init__(self, path: str):
        where, name = _place(path)
        self.file = where.open_output_stream(name)

    def __enter__(self) -> _Out:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def put(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values).tobytes())


class _File:
    def __init__(self, path: str):
        where, name = _place(path)
        self.size = where.get_file_info(name).size
        if self.size is None:
            raise FileNotFoundError(path)
        self.file = where.open_input_file(name)

    def read(self, at: int, dtype: str | np.dtype, n: int) -> np.ndarray:
        dtype = np.dtype(dtype)
        got = self.file.read_at(n * dtype.itemsize, at)
        if len(got) < n * dtype.itemsize:
            raise ValueError("the file ends too early")
        return np.frombuffer(got, dtype)


def read_header(path: str, layout: Layout) -> tuple[int, int]:
    """Numbers of vertices and edges; the file must have the size that they ask for."""
    f = _File(path)
    if f.size < 2 * layout.header:
        raise ValueError(f"{path}: too short for a header")
    n, e = map(int, f.read(0, f"<u{layout.header}", 2))
    if n >= 1 << 32 or layout.bytes(n, e) != f.size:
        raise ValueError(f"{path}: {f.size} bytes, but {n} vertices and {e} edges take {layout.bytes(n, e)}")
    return n, e


@dataclass
class EdgeRange(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, split: int):
        self.path, self.layout = path, layout
        self.n, self.e = read_header(path, layout)
        self.step = max(split // layout.edge_type.itemsize, 1)

    def partitions(self) -> list[EdgeRange]:
        return [EdgeRange(a, min(a + self.step, self.e)) for a in range(0, self.e, self.step)] or [EdgeRange(0, 0)]

    def read(self, partition: EdgeRange) -> Iterator[pa.RecordBatch]:
        """Edges of a range; their owners come from the pointers, which are searched in the file for the range's ends."""
        f, (pointers, edges) = _File(self.path), self.layout.starts(self.n)
        width = self.layout.header

        def pointer(i: int) -> int:
            return int(f.read(pointers + i * width, f"<u{width}", 1)[0])

        def owner(edge: int) -> int:
            lo, hi = 0, self.n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if pointer(mid) <= edge else (lo, mid)
            return lo

        for a in range(partition.first, partition.last, 1 << 18):
            b = min(a + (1 << 18), partition.last)
            first, last = owner(a), owner(b - 1)
            bounds = f.read(pointers + first * width, f"<u{width}", last - first + 1).astype(np.int64)
            own = first + np.searchsorted(bounds, np.arange(a, b), side="right") - 1
            got = f.read(edges + a * self.layout.edge_type.itemsize, self.layout.edge_type, b - a)
            ends = [own.astype(np.int64), got["v"].astype(np.int64)]
            if self.layout.incoming:
                ends.reverse()
            weight = got["w"].astype(np.int64) if self.layout.weighted else np.ones(b - a, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(weight)], ["src", "dst", "weight"])


def _flag(value: str | None) -> bool:
    return str(value).lower() in ("true", "1", "yes")


class CsrSource(DataSource):
    """``spark.read.format("csr").option("weighted", True).load(path)``; see ``Layout`` for options."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src long, dst long, weight long"

    def reader(self, schema) -> CsrReader:
        o = self.options
        layout = Layout(_flag(o.get("weighted")), _flag(o.get("out_degree")), _flag(o.get("incoming")), int(o.get("header", 8)), int(o.get("edge_width", 4)))
        return CsrReader(o["path"], layout, int(o.get("split", SPLIT)))


def read_csr(spark: SparkSession, path: str, layout: Layout | None = None, split: int = SPLIT) -> Graph:
    """The graph of a file; vertices without edges are there too."""
    layout = layout or Layout()
    spark.dataSource.register(CsrSource)
    n, _ = read_header(path, layout)
    options = {"weighted": layout.weighted, "out_degree": layout.out_degree, "incoming": layout.incoming, "header": layout.header, "edge_width": layout.edge_width, "split": split}
    return Graph.from_edges(spark.read.format("csr").options(**options).load(path), spark.range(n))


def stored_out_degrees(path: str) -> np.ndarray:
    """The out-degrees in a file that has them, as given."""
    layout = Layout(out_degree=True)
    n, _ = read_header(path, layout)
    return _File(path).read(16, "<u4", n)


def _stream(df: DataFrame, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """A sorted table a partition at a time: the driver holds one."""
    rows, held = df.select(*columns), []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == 1 << 16:
            yield [np.array(c, dtype=np.int64) for c in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.array(c, dtype=np.int64) for c in zip(*held, strict=True)]


def write_csr(g: Graph, path: str, layout: Layout | None = None) -> None:
    """Write one file.  Sorting is distributed; the file is written by the driver as sorted partitions come in."""
    layout = layout or Layout()
    g = g.dense()
    by = Graph(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), g.vertices) if layout.incoming else g
    rows = cut(csr(by))
    n, e = rows.count(), g.edges.count()
    with _Out(path) as f:
        f.put(np.array([n, e], f"<u{layout.header}"))
        if layout.out_degree:
            for _, degree in _stream(csr(g).orderBy("id"), ["id", "degree"]):
                f.put(degree.astype("<u4"))
        for _, ptr in _stream(rows.orderBy("id"), ["id", "ptr"]):
            f.put(ptr.astype(f"<u{layout.header}"))
        for _, dst, weight in _stream(by.edges.orderBy("src", "dst", "weight"), ["src", "dst", "weight"]):
            out = np.empty(len(dst), layout.edge_type)
            out["v"] = dst
            if layout.weighted:
                out["w"] = weight
            f.put(out)


def widen(path: str) -> str:
    """An old file with 4-byte header and pointers, rewritten with 8-byte edges beside it; the name's last four letters become ``lcsr``."""
    old, new = Layout(header=4), Layout(header=4, edge_width=8)
    n, e = read_header(path, old)
    f, (_, edges) = _File(path), old.starts(n)
    out = f"{path[:-4]}lcsr"
    with _Out(out) as w:
        w.put(f.read(0, "u1", edges))
        for a in range(0, e, 1 << 20):
            w.put(f.read(edges + 4 * a, "<u4", min(1 << 20, e - a)).astype(new.edge_type["v"]))
    return out


def write_bel(g: Graph, prefix: str) -> list[str]:
    """Three files, each with a size and a zero before it: pointers (``.bel.col``), targets (``.bel.dst``), weights (``.bel.val``)."""
    g = g.dense()
    rows = cut(csr(g))
    n, e = rows.count(), g.edges.count()
    names = [f"{prefix}.bel.{x}" for x in ("col", "dst", "val")]
    with _Out(names[0]) as col, _Out(names[1]) as dst, _Out(names[2]) as val:
        for f, size in ((col, n), (dst, e), (val, e)):
            f.put(np.array([size, 0], "<u8"))
        for _, ptr in _stream(rows.orderBy("id"), ["id", "ptr"]):
            col.put(ptr.astype("<u8"))
        for _, to, weight in _stream(g.edges.orderBy("src", "dst", "weight"), ["src", "dst", "weight"]):
            dst.put(to.astype("<u8"))
            val.put(weight.astype("<u4"))
    return names


def bel_summary(path: str) -> tuple[int, int, int]:
    """The two leading numbers of one of the files of ``write_bel`` and the sum of the others, a block at a time."""
    f, width = _File(path), "<u4" if path.endswith(".val") else "<u8"
    size, zero = (int(x) for x in f.read(0, "<u8", 2))
    step = 1 << 20
    return size, zero, sum(int(f.read(16 + int(width[2]) * a, width, min(step, size - a)).sum(dtype=np.uint64)) for a in range(0, size, step))
