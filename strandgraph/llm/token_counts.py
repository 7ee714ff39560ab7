"""Token counts from a tokenizer compiled to a finite-state transducer.

A byte sequence has, for every prefix, exactly one possible last token: the one
that ends there and may follow the last token of the prefix before it.  The
transducer's state holds what later bytes can still ask about: for each place
where an unfinished token may have begun, its node in the vocabulary trie, the
last token before it and its count relative to now.  Reading a byte gives the
next state and the change of the count; both are compiled on first use.

A text is a list of chunks: runs of whole pretokens, and parts of pretokens that are
longer than a chunk.  A chunk becomes a map from the states that may stand before it
to the state after it and the tokens it adds; a pretoken's end leads to the start
state.  The state before a part of a pretoken is guessed by running the bytes before
it from the start state, since a state mostly forgets what lies further back than the
longest token; where the guess fails, composition runs the part from the state that
comes in, so counts are exact.  Maps compose associatively: a prefix scan in
log2(chunks) rounds gives the counts up to every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.bpe import MEMO, VOCABULARY, Bpe, Generations, load
from strandgraph.llm.common import documents, texts_of

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Bytes before a part of a pretoken from which the state before it is guessed.
WARM = 512
#: Characters of units and pretokens that are memoised.
SHORT = 64
#: States of a worker's transducer before it is compiled anew; about 540 bytes each with their transitions, 160 MB.
STATES = 300_000
LIMIT = 512
State = tuple[tuple[int, int, int], ...]
#: Before the first byte of a pretoken: one open place, at the root, without a last token.
START: State = ((0, -1, 0),)


class Transducer:
    """Deterministic; ``table[state << 8 | byte]`` is ``next state << 16 | count change + 2 ** 15``."""

    def __init__(self, bpe: Bpe, most: int = STATES):
        self.bpe, self.most = bpe, max(most, 8)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for i, s in bpe.bytes_of.items():
            if i in bpe.special.values() or bpe.merge(s) != [i]:
                continue  # no text of one pretoken has it
            node = 0
            for b in s:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][b]
            self.token_at[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """State 0 is START."""
        self.states, self.number, self.table = [START], {START: 0}, {}

    def may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        held = self.follows.get((left, right))
        if held is None:
            if len(self.follows) >= 4 * self.most:
                self.follows.clear()
            held = self.bpe.merge(self.bpe.bytes_of[left] + self.bpe.bytes_of[right]) == [left, right]
            self.follows[left, right] = held
        return held

    def compile(self, state: int, byte: int) -> int:
        """The transition of ``state`` on ``byte``."""
        going, last, count = [], None, 0
        for node, before, behind in self.states[state]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at.get(child)
            if last is None and token is not None and self.may_follow(before, token):
                last, count = token, behind + 1
            if self.trie[child]:
                going.append((child, before, behind))
        if last is None:
            raise ValueError("the vocabulary doesn't cover this byte")
        to = (*((c, t, behind - count) for c, t, behind in going), (0, last, 0))
        k = self.number.get(to)
        if k is None:
            k = self.number[to] = len(self.states)
            self.states.append(to)
        out = self.table[state << 8 | byte] = k << 16 | count + 0x8000
        return out

    def run(self, state: State, piece: bytes) -> tuple[State, int]:
        """The state after ``piece`` and the tokens it adds.  States are given whole: their numbers change when the table starts anew."""
        total, i = 0, 0
        while True:
            if len(self.states) > self.most:
                self.reset()
            at = self.number.get(state)
            if at is None:
                at = self.number[state] = len(self.states)
                self.states.append(state)
            table, full = self.table, False
            for i in range(i, len(piece)):
                x = table.get(at << 8 | piece[i])
                if x is None:
                    full = len(self.states) > self.most
                    if full:
                        state = self.states[at]
                        break
                    x = self.compile(at, piece[i])
                total += (x & 0xFFFF) - 0x8000
                at = x >> 16
            if not full:
                return self.states[at], total


class Counts(Generations):
    """unit -> tokens of a short unit, with a memo of its pretokens below."""

    def __init__(self, machine: Transducer, most: int = MEMO):
        self.pieces = Generations(lambda x: machine.run(START, x.encode())[1], most // 2)
        held, cut = self.pieces.__getitem__, machine.bpe.pretokens
        super().__init__(lambda unit: sum(map(held, cut(unit))), most)
        self.machine = machine


@dataclass
class ChunkMap:
    """State before -> (state after, tokens), of a chunk or of two maps one after the other.

    ``to`` has the states that are likely; any other is run through ``piece``, or through both
    halves, and then held.  A piece that ends a pretoken leads to the start state.
    """

    to: dict[State, tuple[State, int]]
    piece: bytes = b""
    ends: bool = True
    halves: tuple[ChunkMap, ChunkMap] | None = None

    def apply(self, state: State, machine: Transducer) -> tuple[State, int]:
        hit = self.to.get(state)
        if hit is None:
            if self.halves:
                middle, n = self.halves[0].apply(state, machine)
                after, more = self.halves[1].apply(middle, machine)
                hit = (after, n + more)
            else:
                after, n = machine.run(state, self.piece)
                hit = (START if self.ends else after, n)
            self.to[state] = hit
        return hit

    def then(self, other: ChunkMap, machine: Transducer) -> ChunkMap:
        both = ChunkMap({}, halves=(self, other))
        for state in list(self.to):
            both.apply(state, machine)
        return both


def maps_of(text: str, counts: Counts, chunk: int = CHUNK) -> Iterator[ChunkMap]:
    """The chunks of a text without special strings, in order."""
    machine, known = counts.machine, 0
    for unit in machine.bpe.units(text):
        if len(unit) <= SHORT:
            known += counts[unit]
            continue
        for x in machine.bpe.pretokens(unit):
            if len(x) <= SHORT:
                known += counts.pieces[x]
                continue
            piece = x.encode()
            if len(piece) <= chunk:
                known += machine.run(START, piece)[1]
                continue
            yield ChunkMap({START: (START, known)})
            known = 0
            for i in range(0, len(piece), chunk):
                part, ends = piece[i : i + chunk], i + chunk >= len(piece)
                guess = machine.run(START, piece[max(i - WARM, 0) : i])[0]
                after, n = machine.run(guess, part)
                yield ChunkMap({guess: (START if ends else after, n)}, part, ends)
    yield ChunkMap({START: (START, known)})


def prefix_scan(maps: list[ChunkMap], machine: Transducer) -> list[ChunkMap]:
    """Inclusive, in log2(n) rounds of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [maps[i - step].then(m, machine) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


@lru_cache(maxsize=4)
def compiled(path: str) -> Counts:
    return Counts(Transducer(load(path)))


def count_tokens(text: str | None, path: str, chunk: int = CHUNK) -> int:
    """Tokens of a whole text; null counts as empty."""
    counts = compiled(path)
    total = 0
    for k, part in enumerate(counts.machine.bpe.segments(text or "")):
        if k % 2:
            total += 1
        else:
            total += prefix_scan(list(maps_of(part, counts, chunk)), counts.machine)[-1].to[START][1]
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path, chunk) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
