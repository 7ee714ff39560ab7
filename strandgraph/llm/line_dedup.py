"""Line deduplication with a log-template tree.

A line's words with a digit are variable fields.  The tree has a fixed depth: token
count, then the leading tokens.  In a leaf, distinct lines are parsed in order of
how common they are: a line joins the first template that agrees with it in
enough places, and places that differ become variable; else it is a new template.
A template that occurs in more than one document is recurring: its first line
stays and all others are dropped.  A line of fewer than ``MIN_TOKENS`` tokens is a
leaf and template of its own: it recurs if its words do, in order, its variable
fields aside; if it has nothing but such fields, they have to be the same too.

Texts become hashes of lines and leaves in numpy; what is shuffled is a few numbers
a line.  Tokens, 16 bits each, are gathered only of leaves with several
distinct lines: a bit set of fixed size, whatever the corpus, tells which those may
be.  A leaf is parsed as a stream that holds only its templates; once there are more
than ``LEAF`` of them, an index names the few that can agree with a line, with the
same result as a comparison with all.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import shingles as sh
from strandgraph.llm.common import broadcast_if_small, cut, documents
from strandgraph.llm.lm_score import grouped, spans

U = np.uint64
#: Leading tokens that a path has; lines with fewer tokens than MIN_TOKENS aren't generalised.
LEADING = 3
MIN_TOKENS = 5
#: Share of places in which a line has to agree with a template.
SIMILARITY = 0.75
#: Templates of a leaf that a line is compared with one and all; more are looked up in an index.
LEAF = 2000
#: Bits of the set of leaves with several lines.  If it fills up, more lines are gathered and nothing is lost.
BITS = 1 << 26
FIELD = 1 << 16

_value = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
STEP = 0xD1342543DE82EF95
_step = np.full(1 << 12, U(STEP), U)
_step[0] = 1
_step = np.cumprod(_step, dtype=U)


def _places(n: int) -> np.ndarray:
    """Odd multipliers by place in a line."""
    global _step
    while len(_step) < n:
        _step = np.concatenate([_step, _step * U(int(_step[-1]) * STEP % (1 << 64))])
    return _step


class Lines:
    """The lines with a word of a group of texts: text, number, token count, hash, leaf, and tokens."""

    def __init__(self, texts: list[bytes]):
        data, s, e, text = spans(texts)
        if not len(s):
            self.text = self.no = self.n = self.first = np.empty(0, np.int64)
            self.hash = self.leaf = self.tokens = np.empty(0, U)
            return
        up, down = sh._power(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_value[data] * up[: len(data)], out=sums[1:])
        tokens = sh.mix((sums[e] - sums[s]) * down[s])
        count = lambda hit: np.concatenate([[0], np.cumsum(hit)])
        digits = count((data >= 48) & (data <= 57))
        plain, field = tokens.copy(), digits[e] > digits[s]
        tokens[field] = U(FIELD)
        newlines = count(data == 10)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        no = newlines[s] - newlines[(np.cumsum(sizes) - sizes)[text]]
        new = np.concatenate(([True], (no[1:] != no[:-1]) | (text[1:] != text[:-1])))
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(s)))
        self.text, self.no, self.tokens = text[self.first], no[self.first], tokens
        place = np.arange(len(s)) - np.repeat(self.first, self.n)
        short = self.n < MIN_TOKENS
        bare = np.repeat(short & np.logical_and.reduceat(field, self.first), self.n)
        tokens[bare] = plain[bare]
        self.hash = sh.mix(np.add.reduceat(tokens * _places(int(self.n.max()))[place], self.first) + self.n.astype(U))
        leading = np.zeros(len(self.first), U)
        for k in range(LEADING):
            at = np.minimum(self.first + k, len(self.tokens) - 1)
            leading += np.where(self.n > k, self.tokens[at] * sh.PLACES[k], U(0))
        self.leaf = np.where(short, self.hash, sh.mix(leading + self.n.astype(U) * U(sh.BASE)))

    def token_bytes(self, i: int) -> bytes:
        """16 bits a token; 0 is a variable field."""
        t = self.tokens[self.first[i] : self.first[i] + self.n[i]]
        return np.where(t == U(FIELD), 0, np.maximum(t >> U(48), 1)).astype(np.uint16).tobytes()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def scan(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, text_hash, line_no, leaf, line_hash, n_lines): a row for each line of ``least`` tokens at least, and one with line_no -1 for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "line_no", "leaf", "line_hash", "n_lines"]
        for b in batches:
            ids = b.column("doc_id")
            for at, texts in grouped(b.column("text").to_pylist()):
                x, own = Lines(texts), ids.slice(at, len(texts))
                hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], U)
                zero = np.zeros(len(texts), np.int64)
                n_lines = np.bincount(x.text, minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own, _signed(hashes), pa.array(zero - 1), pa.array(zero), pa.array(zero), pa.array(n_lines)], names)
                some = np.flatnonzero(x.n >= least)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(x.text[some])), _signed(hashes[x.text[some]]), pa.array(x.no[some].astype(np.int64)), _signed(x.leaf[some]), _signed(x.hash[some]), pa.array(np.zeros(len(some), np.int64))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_hash long, line_no long, leaf long, line_hash long, n_lines long")


def leaf_bits(leaves: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bit set of (leaf): ``bits / 8`` bytes.  Words are put together by aggregation; the driver gets at most ``bits / 64`` of them."""
    place = F.pmod(F.col("leaf"), F.lit(bits))
    words = leaves.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(leaf, {bits}), 64) AS INT))")).alias("b")).toArrow()
    out = np.zeros(max(bits // 64, 1), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def gather(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(leaf, line_hash, tokens, copies) of distinct lines in leaves whose bit is set."""
    held, size = docs.sparkSession.sparkContext.broadcast(bits), len(bits) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for b in batches:
            for _, texts in grouped(b.column("text").to_pylist()):
                x = Lines(texts)
                place = np.mod(x.leaf.view(np.int64), size)
                some = np.flatnonzero((x.n >= MIN_TOKENS) & ((words[place >> 6] >> (place & 63)) & 1 == 1))
                _, one, copies = np.unique(x.hash[some], return_index=True, return_counts=True)
                some = some[one]
                yield pa.RecordBatch.from_arrays(
                    [_signed(x.leaf[some]), _signed(x.hash[some]), pa.array([x.token_bytes(i) for i in some], pa.binary()), pa.array(copies.astype(np.int64))],
                    ["leaf", "line_hash", "tokens", "copies"],
                )

    found = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "leaf long, line_hash long, tokens binary, copies long")
    return found.groupBy("leaf", "line_hash").agg(F.first("tokens").alias("tokens"), F.sum("copies").alias("copies"))


class Parser:
    """Templates of one leaf, whose lines come one by one; a template has its first line's hash.  0 is a variable field."""

    def __init__(self, n: int, similarity: float = SIMILARITY, leaf_size: int = LEAF):
        self.n, self.least, self.leaf_size = n, similarity * n, leaf_size
        self.names: list[int] = []
        self.table = np.empty((4, n), np.uint16)
        # a line that agrees with a template differs from it in ``parts - 1`` places at most, so one of ``parts`` parts is the same
        parts = n - math.ceil(self.least) + 1
        self.edges = [LEADING + (n - LEADING) * i // parts for i in range(parts + 1)] if 0 < parts <= n - LEADING else None
        self.index: defaultdict[tuple[int, bytes], list[int]] | None = None

    def _parts(self, tokens: np.ndarray) -> list[tuple[int, bytes]]:
        return [(lo, tokens[lo:hi].tobytes()) for lo, hi in zip(self.edges, self.edges[1:], strict=False)]

    def _first(self, tokens: np.ndarray) -> int | None:
        """The first template that agrees with ``tokens``."""
        if self.index is None:
            if self.edges is None or len(self.names) <= self.leaf_size:
                hit = np.flatnonzero((self.table[: len(self.names)] == tokens).sum(axis=1) >= self.least)
                return int(hit[0]) if len(hit) else None
            self.index = defaultdict(list)
            for i in range(len(self.names)):
                self._enter(i, self._parts(self.table[i]))
        some = np.unique(np.array([i for part in self._parts(tokens) for i in self.index.get(part, ())], np.int64))
        hit = np.flatnonzero((self.table[some] == tokens).sum(axis=1) >= self.least)
        return int(some[hit[0]]) if len(hit) else None

    def _enter(self, i: int, parts: list[tuple[int, bytes]]) -> None:
        for part in parts:
            self.index[part].append(i)

    def __call__(self, key: int, tokens: np.ndarray) -> int:
        # the leaf has one token count; were two to share a hash, they would be parsed apart
        if len(tokens) != self.n:
            return key
        i = self._first(tokens)
        if i is not None:
            t = self.table[i]
            if (t != tokens).any():
                before = set(self._parts(t)) if self.index is not None else None
                t[t != tokens] = 0
                if before is not None:  # what the index has of the template before is harmless: each hit is compared in full
                    self._enter(i, [part for part in self._parts(t) if part not in before])
            return self.names[i]
        if len(self.names) == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[len(self.names)] = tokens
        if self.index is not None:
            self._enter(len(self.names), self._parts(tokens))
        self.names.append(key)
        return key


def parse(rows: list[tuple[int, np.ndarray]], similarity: float = SIMILARITY, leaf_size: int = LEAF) -> list[tuple[int, int]]:
    """(line, template) hashes of one leaf's distinct lines, in the order given."""
    parser = Parser(len(rows[0][1]) if rows else 0, similarity, leaf_size)
    return [(key, parser(key, tokens)) for key, tokens in rows]


def templates(distinct: DataFrame, similarity: float = SIMILARITY, leaf_size: int = LEAF) -> DataFrame:
    """(leaf, line_hash, template) for lines whose template isn't their own.  A leaf is one task's: which template a line joins depends on all lines before it."""
    dealt = distinct.repartition("leaf").sortWithinPartitions("leaf", F.desc("copies"), "line_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        parser = Parser(0)
        for b in batches:
            moved: list[tuple[int, int, int]] = []
            for leaf, key, tokens in zip(*(b.column(c).to_pylist() for c in ("leaf", "line_hash", "tokens")), strict=True):
                line = np.frombuffer(tokens, np.uint16)
                if leaf != at:
                    at, parser = leaf, Parser(len(line), similarity, leaf_size)
                template = parser(key, line)
                if template != key:
                    moved.append((leaf, key, template))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in moved], pa.int64()) for i in range(3)], ["leaf", "line_hash", "template"])

    return dealt.select("leaf", "line_hash", "tokens").mapInArrow(run, "leaf long, line_hash long, template long")


def dropped_lines(docs: DataFrame, scanned: DataFrame, similarity: float = SIMILARITY, leaf_size: int = LEAF) -> DataFrame:
    """(doc_id, text_hash, line_no) of lines that go; ``scanned`` is what ``scan`` gives, written."""
    every = scanned.where("line_no >= 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash", "line_no", "leaf", "line_hash")
    where = F.struct("doc_id", "line_no", "text_hash")
    distinct = cut(every.groupBy("leaf", "line_hash").agg(F.min(where).alias("first"), F.max("doc_id").alias("hi")))
    several = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    moved = cut(templates(gather(docs, leaf_bits(several)), similarity, leaf_size))
    named = distinct.join(moved, ["leaf", "line_hash"], "left").withColumn("template", F.coalesce("template", "line_hash"))
    # the line that stays goes along with each of its template's lines, so lines meet their template in one join
    again = named.groupBy("leaf", "template").agg(F.min("first").alias("stay"), F.max("hi").alias("last_doc")).where("stay.doc_id <> last_doc")
    recurring = cut(named.join(again, ["leaf", "template"]).select("leaf", "line_hash", "stay"))
    return every.join(broadcast_if_small(recurring), ["leaf", "line_hash"]).where(where != F.col("stay")).select("doc_id", "text_hash", "line_no").distinct()


def line_verdicts(docs: DataFrame, similarity: float = SIMILARITY, leaf_size: int = LEAF, least: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` for each row: lines with a word, and the numbers (from 0) of those that go, joined by commas.

    ``least`` tokens make a line that may go: 1 for all lines.
    Null and empty texts have no lines; rows that repeat a doc_id are one
    document to the tree (rows that repeat its text too share one verdict);
    rows without doc_id are left alone; an empty table gives an empty result.
    """
    scanned = cut(scan(docs, least))
    gone = dropped_lines(docs, scanned, similarity, leaf_size).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("line_no")).alias("nos"))  # a document's own lines
    joined = scanned.where("line_no < 0").select("doc_id", "text_hash", "n_lines").join(gone, ["doc_id", "text_hash"], "left")
    nos = F.coalesce("nos", F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    return joined.select("doc_id", "n_lines", F.size(nos).cast("long").alias("n_dropped"), F.array_join(nos, ",").alias("dropped"))


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, leaf_size: int = LEAF, least: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; other columns stay as they are."""
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    gone = dropped_lines(docs, cut(scan(docs, least)), similarity, leaf_size).groupBy("doc_id").agg(F.collect_set("line_no").alias("nos"), F.count_distinct("text_hash").alias("texts"))
    # an id with several texts keeps them as they are: its lines can't be told apart by number
    joined = whole.join(gone.where("texts = 1"), F.col("id") == F.col("doc_id"), "left")
    kept = F.filter(F.split(F.col("row.text"), "\n"), lambda _, i: ~F.array_contains("nos", i.cast("long")))
    cleaned = F.when(F.col("nos").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(cleaned.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(documents(spark, sf_dir), least=1)
