"""Byte-level BPE: encode with a priority queue over a linked symbol list, decode by concatenation.

A text is cut into *units* that are encoded alone, and their ids are memoised: the
pretokens themselves if the text has plain characters only, else a run of ASCII
white space and the run of other characters after it.  A pretoken never crosses the
place where a character that isn't white space is followed by white space.  The memo
is bounded in bytes; that never changes results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm.common import bound_batches, documents, memos, texts_of

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a worker's memo, about, and of its largest entry: longer units and pretokens aren't held.
MEMO = 80 << 20
LARGEST = 1 << 10
OVERHEAD = 200
#: Bits of a place in ``Bpe.merge``'s queue: with 16 bits of a rank a number of one digit in CPython; for longer pretokens.
PLACE = 14
FAR = 40
PLACES = range(1 << PLACE)
UNIT = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
#: White space beyond ASCII (fixed values): such texts are cut by the full pattern at once.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Outside these blocks letter and number classes depend on the Unicode version, so the library's own splitter is asked.
VERSIONED = re.compile("[^\x00-\u0557\u2000-\u2070\u2100-\u218f\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef]")

#: Letters, numbers and white space among the plain characters, those whose classes are fixed and written out here.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e]")
#: ``public_tokenizers.PATTERN`` over plain characters, for the standard library's faster ``re``.
PLAIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Certainly one pretoken.
WORD = re.compile(f" ?(?:[{LETTERS}]+|[{NUMBERS}]+)")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary file: itself if printable, else 256 and up in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Bpe:
    """A vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        raw = {c: b for b, c in enumerate(byte_letters())}
        vocab = held["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(raw.__getitem__, s)) for s, i in vocab.items()}
        self.single = [vocab[c] for c in byte_letters()]
        self.merged: list[int] = []
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.append(vocab[a + b])
            self.rank.setdefault((vocab[a], vocab[b]), rank)
        self.tables: dict[int, tuple[list[list[int]], list[dict[int, int]]]] = {}
        self.special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken = regex.compile(public_tokenizers.PATTERN)
        self.path = path
        self._library = None

    def ranks(self, bits: int) -> tuple[list[list[int]], list[dict[int, int]]]:
        """Ranks ``<< bits`` by left and right byte (-1: none) and by left and right id; the last row is that of no symbol."""
        if bits not in self.tables:
            none: dict[int, int] = {}
            rows = [none] * (max(self.bytes_of) + 2)
            for (left, right), r in self.rank.items():
                if rows[left] is none:
                    rows[left] = {}
                rows[left][right] = r << bits
            self.tables[bits] = [[rows[a].get(b, -1) for b in self.single] for a in self.single], rows
        return self.tables[bits]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pretoken: the lowest-ranked adjacent pair first, leftmost among equals.

        The queue holds ``rank << bits | place``.  ``now`` has the entry of the pair that begins at each place, negative if
        that has no rank; an entry that differs from it is stale and skipped.
        """
        n = len(piece)
        bits, places = (PLACE, PLACES) if n <= len(PLACES) else (FAR, range(n))
        first, rows = self.ranks(bits)
        now = [first[a][b] | i for i, a, b in zip(places, piece, piece[1:])]
        queue = [x for x in now if x >= 0]
        ids = list(map(self.single.__getitem__, piece))
        if not queue:
            return ids
        heapq.heapify(queue)
        # one more place, after the last and before the first, where no symbol is
        now.append(-1)
        ids.append(len(rows) - 1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pop, push, merged, mask = heapq.heappop, heapq.heappush, self.merged, (1 << bits) - 1
        while queue:
            x = pop(queue)
            i = x & mask
            if now[i] != x:
                continue
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            now[j] = ids[j] = -1
            one = ids[i] = merged[x >> bits]
            row, right = rows[one], ids[k]
            if right in row:
                x = now[i] = row[right] | i
                push(queue, x)
            else:
                now[i] = -1
            h = before[i]
            row = rows[ids[h]]
            if one in row:
                x = now[h] = row[one] | h
                push(queue, x)
            else:
                now[h] = -1
        ids.pop()
        return [x for x in ids if x >= 0]

    def pretokens(self, text: str) -> list[str]:
        if not OTHER.search(text):
            return PLAIN.findall(text)
        if VERSIONED.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.pretoken.findall(text)

    def segments(self, text: str) -> list[str]:
        """Texts and special strings in turn."""
        return self.cut.split(text) if self.cut else [text]

    @staticmethod
    def units(text: str) -> list[str]:
        return [text] if WIDE_SPACE.search(text) else UNIT.findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                for unit in self.units(part):
                    for x in self.pretokens(unit):
                        out += self.merge(x.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


class Generations(dict):
    """A bounded memo: what was asked for lately stays when a new generation begins.

    An entry counts as ``OVERHEAD + 4 * len(key)`` bytes; two generations together hold ``most``.
    """

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most // 2
        self.before: dict = {}
        self.size = 0

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        cost = OVERHEAD + 4 * len(key)
        if cost <= LARGEST:
            if self.size + cost > self.most:
                self.before, self.size = dict(self), 0
                self.clear()
            self[key] = got
            self.size += cost
        return got


class Coder:
    """Units to ",id,id..." and back."""

    def __init__(self, bpe: Bpe, most: int = MEMO + MEMO // 2):
        self.bpe = bpe
        top = max(bpe.bytes_of, default=-1) + 1
        self.name = [f",{i}" for i in range(top)].__getitem__
        self.strings = np.empty(top, object)
        self.strings[:] = [bpe.bytes_of.get(i, b"") for i in range(top)]
        # one memo for units and the pretokens of longer ones
        self.units = self.pieces = Generations(self.spell, most)

    def spell(self, unit: str) -> str:
        if not WORD.fullmatch(unit):
            found = self.bpe.pretokens(unit)
            if len(found) > 1:
                return "".join(map(self.units.__getitem__, found))
        return "".join(map(self.name, self.bpe.merge(unit.encode())))

    def encode(self, text: str) -> str:
        """``text`` has no special strings."""
        cut = PLAIN.findall if not OTHER.search(text) else self.bpe.units
        return "".join(map(self.units.__getitem__, cut(text)))

    def decode(self, ids: str) -> bytes:
        """The vocabulary strings of ",id,id...", one after another."""
        return b"".join(self.strings[np.fromstring(ids[1:], np.int64, sep=",")].tolist()) if ids else b""


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    """One for a Python worker, which Spark reuses for later tasks."""
    return Coder(load(path))


memos += [coder.cache_clear, load.cache_clear]


def round_trip(text: str | None, path: str) -> tuple[str, bytes]:
    """Ids as ",id,id..." and the bytes that decoding them gives."""
    c = coder(path)
    found: list[str] = []
    for k, part in enumerate(c.bpe.segments(text or "")):
        if k % 2:
            found.append(f",{c.bpe.special[part]}")
        else:
            found.append(c.encode(part))
    ids = "".join(found)
    return ids, c.decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string``: the token ids of each whole text and what they decode to.

    Null and empty texts have no ids and decode to the empty text; repeated rows
    are encoded each; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [round_trip(t, path) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "ids": [[int(i) for i in s[1:].split(",")] if s else [] for s, _ in both],
                "decoded": [d.decode("utf-8", "replace") for _, d in both],
            })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; see ``encode_documents`` for nulls and repeats."""
    import pyarrow as pa

    path = path or public_tokenizers.path(VOCABULARY)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for t in texts_of(b):
                ids, decoded = round_trip(t, path)
                n.append(ids.count(","))
                ids_sha.append(hashlib.sha256(ids[1:].encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir))
