"""Sizing of the resident part of the edges: plain arithmetic, a hint for caching."""

from __future__ import annotations

from dataclasses import dataclass

GIB = 1 << 30
#: Fixed values by algorithm: bytes of an edge, arrays of 4 bytes that a vertex has beside it, bytes of its value, memory.
PROFILES = {
    "bfs": (4, 17, 0, 12 * GIB),
    "cc": (4, 17, 0, 12 * GIB),
    "sssp": (8, 19, 8, 12 * GIB),
    "pagerank": (4, 17, 16, 10 * GIB),
}
MOST_EDGES = (1 << 32) - 1


@dataclass(frozen=True)
class RegionPlan:
    total_edges_that_fit: int
    share: float
    cap: int


def reserved_bytes(algorithm: str, n_vertices: int, param: int | None = None) -> int:
    """Memory that vertices take: ``param`` words each, two of which make way for wide values where there are such."""
    _, words, wide, _ = PROFILES[algorithm]
    words = words if param is None else param
    if not wide:
        return words * 4 * n_vertices
    return (words - 2) * 4 * n_vertices + wide * n_vertices


def plan_static_region(algorithm: str, n_vertices: int, n_edges: int, rate: float = 0.0, available: int | None = None, param: int | None = None) -> RegionPlan:
    """How many edges to keep resident.

    The share is ``(10 - edges / fitting) / 9``, a half if that is negative and
    at most 1; a positive ``rate`` takes its place.
    """
    if algorithm not in PROFILES:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    edge_bytes, _, _, memory = PROFILES[algorithm]
    fitting = max((memory if available is None else available) - reserved_bytes(algorithm, n_vertices, param), 0) // edge_bytes
    share = (10 - n_edges / fitting) / 9 if fitting else -1.0
    share = 0.5 if share < 0 else min(share, 1.0)
    if rate > 0:
        share = rate
    return RegionPlan(fitting, share, min(int(share * fitting), n_edges, MOST_EDGES))


def max_subgraph_edges(algorithm: str, n_vertices: int) -> int:
    """Edges of a sub-graph that is processed at once."""
    if algorithm == "pagerank":
        return int(0.75 * (10 * GIB - 152 * n_vertices) / 4)
    return int(0.9 * (12 * GIB - 32 * n_vertices) / 4)
