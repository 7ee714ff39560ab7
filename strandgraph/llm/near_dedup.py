"""MinHash near-deduplication by a chosen-path set similarity join.

Every distinct shingle set is put into independent trees.  In each tree a set
orders its shingles by that tree's hash and follows the paths that its smallest
shingles choose, ``BRANCH`` of them at each node; similar sets choose the same
paths with a probability that independent trees raise to the target recall.
Nodes are compared level by level:

1. Every set is compared with the most central set of the node it shares most
   often, a star, so that a group of copies costs as many comparisons as it has members.
2. Nodes that still mix components and are small are compared exhaustively across
   components; those that are large branch again, one shingle deeper.
3. What is large at the last level is a crowd of similar sets.  Crowds that
   share members are compared once, exhaustively and in blocks of bounded size,
   each of which returns a spanning forest of its links; no candidate is dropped.

Every link is confirmed on full sets.  Components come from hooking and pointer
jumping on tables; nothing of the size of the corpus reaches the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.checkpoints import checkpoint_dir
from strandgraph.llm.common import bound_batches, broadcast_if_small, cut, documents, drop_memos, release, texts_of
from strandgraph.llm.shingles import U, linked, mix, shingle_sets

PERCENT = 75
#: Missed links between sets at the threshold, at most, in theory: see ``tree_count``.
RECALL = 0.999999
#: Children that a set chooses at each node, and how many levels there are.
BRANCH = 2
LEVELS = 3
#: Sets of a block in which a large node of the last level is compared.
BLOCK = 256
#: A node is compared exhaustively if its members outside its largest component, times its members, are at most so many.
SMALL = 4096
#: Small first-level nodes that two sets have to share to be compared; ``tree_count`` allows for it.
HITS = 2


def tree_count(recall: float = RECALL, percent: int = PERCENT, branch: int = BRANCH, levels: int = LEVELS, hits: int = HITS) -> int:
    """Independent trees so that two sets at the threshold are compared with the given probability.

    Below a common node, two sets go on together unless none of the ``branch``
    smallest shingles of what is left of their union is common; the smallest is
    common with probability ``percent / 100``.  A pair is missed if it meets in fewer
    than ``hits`` of the trees whose first-level nodes are small, and in no
    tree down to the last level where they are large; which trees are which is taken at its worst.
    """
    meets = 1 - (1 - percent / 100) ** branch
    few = lambda n: sum(math.comb(n, k) * meets**k * (1 - meets) ** (n - k) for k in range(min(hits, n + 1)))
    trees = 1
    while max(few(n) * (1 - meets**levels) ** (trees - n) for n in range(trees + 1)) > 1 - recall:
        trees += 1
    return trees


def _multipliers(trees: int) -> np.ndarray:
    return np.random.default_rng(75).integers(0, 2**63, trees, dtype=np.int64).astype(U) * U(2) + U(1)


def sketches(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, set size, a 128-bit fingerprint of the set and, for each tree, its ``depth`` smallest shingles."""
    by = _multipliers(trees)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        for b in batches:
            n, one, two, pools = [], [], [], []
            for s in shingle_sets(texts_of(b)):
                n.append(len(s))
                one.append(int(s.sum(dtype=U).astype(np.int64)))
                two.append(int(mix(s ^ U(0x5DEECE66D)).sum(dtype=U).astype(np.int64)))
                if len(s) > depth:
                    pool = np.partition(s[None, :] * by, depth - 1, axis=1)[:, :depth]
                else:
                    pool = np.full((trees, depth), ~U(0), U)
                    pool[:, : len(s)] = s[None, :] * by
                pool.sort(axis=1)
                pools.append(pool.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(pools, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "pool"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, pool binary")


def entries(sets: DataFrame, trees: int, depth: int, branch: int) -> DataFrame:
    """(node, rep, at): the first-level nodes of each set of (rep, pool); ``at`` is tree * depth + position of the chosen shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, trees + 1, dtype=U))
        at = (np.arange(trees)[:, None] * depth + np.arange(branch)[None, :]).astype(np.int32)
        for b in batches:
            rep = np.asarray(b.column("rep"))
            pool = np.frombuffer(b"".join(b.column("pool").to_pylist()), U).reshape(len(rep), trees, depth)
            chosen = pool[:, :, :branch]
            node = mix(seeds[None, :, None] * U(31) + chosen).view(np.int64)
            full = chosen != ~U(0)
            out = [node, np.broadcast_to(rep[:, None, None], node.shape), np.broadcast_to(at[None], node.shape)]
            yield from _slices([x[full] for x in out], ["node", "rep", "at"])

    return sets.select("rep", "pool").mapInArrow(run, "node long, rep long, at int")


def branches(large: DataFrame, pools: DataFrame, depth: int, branch: int) -> DataFrame:
    """Entries one level deeper: each member of a large node chooses its next ``branch`` shingles in the node's tree."""
    of = large.groupBy("rep").agg(F.collect_list("node").alias("nodes"), F.collect_list("at").alias("ats"))  # one set's own paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, ats = b.column("nodes"), b.column("ats")
            n = np.diff(np.asarray(nodes.offsets))
            row = np.repeat(np.arange(len(n)), n)
            parent, at = np.asarray(nodes.flatten()).view(U), np.asarray(ats.flatten())
            pool = np.frombuffer(b"".join(b.column("pool").to_pylist()), U).reshape(len(n), -1)
            rep = np.asarray(b.column("rep"))[row]
            for k in range(1, branch + 1):
                inside = at % depth + k < depth
                chosen = pool[row[inside], at[inside] + k]
                full = chosen != ~U(0)
                node = mix(parent[inside] * U(31) + chosen).view(np.int64)
                yield from _slices([node[full], rep[inside][full], (at[inside] + k)[full].astype(np.int32)], ["node", "rep", "at"])

    return of.join(pools, "rep").select("rep", "nodes", "ats", "pool").mapInArrow(run, "node long, rep long, at int")


def _slices(columns: list[np.ndarray], names: list[str], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in columns], names)


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), written already, those whose full shingle sets are linked.

    Texts of sets in no pair aren't moved.  Joined on b last, so that a star's centre comes in runs.
    """
    size_of = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"))
    sized = pairs.join(size_of("a"), "a").join(size_of("b"), "b")
    sized = cut(sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    ids = broadcast_if_small(cut(sized.select(F.col("a").alias("rep")).union(sized.select("b")).distinct()))
    path = f"{checkpoint_dir(docs.sparkSession)}/near-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi").dropDuplicates(["rep"]).write.parquet(path)  # compressed, unlike a checkpoint
    texts = docs.sparkSession.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        held: tuple[int | None, np.ndarray] = (None, np.empty(0, U))
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            centres = batch.column("tb")
            out: list[int] = []
            for i, s in enumerate(shingle_sets(texts_of(batch, "ta"))):
                if held[0] != b[i]:
                    held = (b[i], next(shingle_sets([centres[i].as_py()])))
                if linked(s, held[1], percent):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], ["a", "b"])

    ta, tb = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    both = sized.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each component of the graph of ``edges`` (a, b), for ids that have an edge.

    Each round a vertex whose label has changed sends it to its neighbours, then labels jump to their labels' labels;
    the rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = cut(both)
    state = both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    state = cut(state.withColumn("fresh", F.col("label") != F.col("id")))
    while True:
        sent = state.where("fresh").select(F.col("id").alias("from"), "label")
        seen = both.join(sent, F.col("b") == F.col("from")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = state.join(seen, state["id"] == seen["a"], "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        up = state.select(F.col("id").alias("p"), F.col("label").alias("top"))
        moved = hooked.join(up, F.col("low") == F.col("p"), "left").select("id", F.least("low", F.coalesce("top", "low")).alias("new"), "label")
        state = cut(moved.select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("fresh")))
        release(state.sparkSession)
        if state.where("fresh").isEmpty():
            return state.select("id", "label")


def _sharing(found: DataFrame) -> DataFrame:
    """Entries of nodes with two members at least, with the node's size."""
    found = found.repartition("node")
    sizes = found.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return found.join(sizes, "node")


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each set with one more central set.  The more members a set's nodes have together, the more central it is."""
    centre = shared.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = shared.select("node", "rep").join(centre, "rep").withColumn("rank", F.struct("weight", "rep"))
    pivots = weighed.groupBy("node").agg(F.max("rank").alias("pivot"))
    hits = weighed.join(pivots, "node").where("rank <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.where(F.col("hits") >= HITS).groupBy("rep").agg(F.max(F.struct("hits", "pivot")).alias("best"))
    return best.select(F.col("rep").alias("a"), F.col("best.pivot.rep").alias("b"))


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; of ``left`` with ``right`` if there are both.  Intersections come from products of 0/1 matrices over the shingles that two sets share, so many at a time."""
    sets = left + (right or [])
    n, k = len(sets), len(left)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    column = np.where(np.bincount(column)[column] > 1, column, -1)
    row, column = row[column >= 0], column[column >= 0]
    if not len(row):
        return []
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    a, b = (slice(0, n), slice(0, n)) if right is None else (slice(0, k), slice(k, n))
    both = 0
    for at in range(0, int(column[-1]) + 1, columns):
        lo, hi = np.searchsorted(column, (at, at + columns))
        m = np.zeros((n, columns), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        both = both + m[a] @ m[b].T
    both = np.rint(both).astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (both > 0))
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x.tolist(), (y + b.start).tolist(), strict=True):
        u, v = top(i), top(j)
        if u != v:
            parent[v] = u
            out.append((i, j))
    return out


def crowd_links(large: DataFrame, docs: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) in crowds: large nodes of the last level (node, rep), taken together where they share members."""
    pivots = large.groupBy("node").agg(F.min("rep").alias("a"))
    crowds = components(large.join(pivots, "node").select("a", F.col("rep").alias("b")))
    crowds = cut(crowds.select(F.col("id").alias("rep"), F.col("label").alias("crowd")))
    sizes = crowds.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = crowds.join(sizes, "crowd").withColumn("own", own)
    # a set goes to its block's pair with every block, itself included
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "crowd", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    ids = broadcast_if_small(crowds.select("rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi").dropDuplicates(["rep"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([x.tobytes() for x in shingle_sets(texts_of(b))], pa.binary())], ["rep", "shingles"])

    dealt = placed.join(texts.mapInArrow(sets, "rep long, shingles binary"), "rep").repartition("crowd", "p", "q").sortWithinPartitions("crowd", "p", "q", "own", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(at: tuple[int, int, int], held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            left = [(r, np.frombuffer(x, U)) for r, own, x in held if own == at[1]]
            right = [(r, np.frombuffer(x, U)) for r, own, x in held if own != at[1]] if at[1] != at[2] else None
            found = block_links([x for _, x in left], None if right is None else [x for _, x in right], percent) if right is None or (left and right) else []
            reps = [r for r, _ in left + (right or [])]
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in found], pa.int64()), pa.array([reps[j] for _, j in found], pa.int64())], ["a", "b"])

        at, held = None, []
        for b in batches:
            for rep, crowd, own, p, q, x in zip(*(b.column(c).to_pylist() for c in ("rep", "crowd", "own", "p", "q", "shingles")), strict=True):
                if (crowd, p, q) != at:
                    if held:
                        yield flush(at, held)
                    at, held = (crowd, p, q), []
                held.append((rep, own, x))
        if held:
            yield flush(at, held)

    return dealt.select("rep", "crowd", "own", "p", "q", "shingles").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, branch: int = BRANCH, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Defined results: null, empty and blank texts have no shingles and are alone;
    one to four words are one shingle; rows that repeat a doc_id belong to that id's component;
    null ids are alone and kept; an empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    trees, depth = tree_count(recall, percent, branch, levels), levels + branch - 1
    sketched = cut(sketches(docs, trees, depth))
    members = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = members.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member_of = cut(members.select("doc_id", "f1", "f2", "n_shingles").join(sets, ["f1", "f2", "n_shingles"]).select("doc_id", "rep", F.col("n_shingles").alias("n")))
    reps = member_of.where("doc_id = rep").select("rep", "n").distinct()
    pools = sketched.select(F.col("doc_id").alias("rep"), "pool").join(reps, "rep", "left_semi").dropDuplicates(["rep"])

    shared = cut(_sharing(entries(pools, trees, depth, branch)))
    if shared.isEmpty():
        return _labelled(docs, sketched, member_of, None)

    stars = cut(_stars(shared))
    release(docs.sparkSession)
    links = cut(confirm(stars, docs, reps, percent))
    labels = components(links)

    wide = shared.select("node", "rep", "at")
    found: list[DataFrame] = []
    for level in range(1, levels + 1):
        mixed = cut(_mixed(wide, labels))
        release(docs.sparkSession)
        now = F.col("outside") * F.col("members") <= small
        compare = mixed.where(now)
        minor = compare.where("label <> major").select("node", F.col("rep").alias("x"), F.col("label").alias("lx"), "major")
        other = compare.select("node", F.col("rep").alias("y"), F.col("label").alias("ly"), F.col("major").alias("my"))
        across = minor.join(other, "node").where((F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("my")) | (F.col("x") < F.col("y"))))
        pairs = across.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("hits"))
        found.append(pairs.where(F.col("hits") >= (HITS if level == 1 else 1)).select("a", "b"))
        large = mixed.where(~now).select("node", "rep", "at")
        if large.isEmpty():
            large = None
            break
        if level < levels:
            wide = branches(large, pools, depth, branch)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    more = confirm(cut(every.distinct()), docs, reps, percent)
    if large is not None:
        more = more.union(crowd_links(large.select("node", "rep"), docs, percent))
    return _labelled(docs, sketched, member_of, components(cut(links.union(more))))


def _mixed(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of nodes that hold two components at least: with the node's largest one and how many members are outside it."""
    named = wide.join(labels, wide["rep"] == labels["id"], "left").select("node", "rep", "at", F.coalesce("label", "rep").alias("label"))
    parts = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top"))
    nodes = nodes.select("node", "members", F.col("top.label").alias("major"), (F.col("members") - F.col("top.n")).alias("outside")).where("outside > 0")
    return named.join(nodes, "node")


def _labelled(docs: DataFrame, sketched: DataFrame, member_of: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        of = member_of.select("doc_id", F.col("rep").alias("component_id"))
    else:
        of = member_of.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("label", "rep").alias("component_id"))
    of = of.groupBy(F.col("doc_id").alias("member")).agg(F.min("component_id").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(of, F.col("doc_id") == F.col("member"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
