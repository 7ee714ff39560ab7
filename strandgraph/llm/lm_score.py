"""Language-model scores: a causal self-attention model in numpy, beside exact word counts.

*Subwords.*  The vocabulary has a bounded number of words, the most frequent, and all
pieces of one or two bytes, apart by whether they begin a word.  A word
(lower-cased, UTF-8) outside the vocabulary is spelled in such pieces, so every
text has ids, and a text ends with an end.  Ids are classes of their own if
frequent; other words share a class by their last two bytes, pieces by their first
byte.  Which bytes a piece has is up to the model too: one softmax over its first byte, one over its
second.  Before fitting they give what counts of the first byte after the
two bytes before it in the word give, and of the second after the two before that one; such pairs are
hashed to ``ROWS`` rows.  Of each word's training occurrences ``DISCOUNT`` are fitted on as spelled, by a
hash of text and place, and taken off its count: that is what the model gives to words that it hasn't seen.

*Model.*  One layer of single-head causal attention with a learned bias by
distance, a feed-forward layer and softmaxes: over classes, and over the bytes of a piece; a
piece is read by its last byte.  A word's probability in its class comes from exact counts over all
training texts.  Each subword is scored
once, with a context of at least ``CONTEXT - STRIDE`` subwords where the text has
them, in overlapping windows that are stacked into masked batches.  Before
fitting, the model gives each class its share of the training subwords.

*Fitting.*  Class ids, a byte a subword, are written once.  Those of training texts
are dealt by a hash of the text, in chunks, into shards of about ``SHARD`` subwords and
into ``ROUNDS`` passes; each window of every training text is fitted on, in one
pass.  A shard fits the current model on its chunks in the order of their hashes,
and the shards' models are averaged by their number of windows.  Neither
the partitions that texts come in nor the number of tasks changes the result.  What
reaches the driver has the size of one model.

*Counts.*  Word counts are exact over all training texts.  Frequent words (a
bounded table, at most ``HEAD``) are looked up in the task; the others are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import shingles as sh
from strandgraph.llm.common import cut, documents, stored, texts_of

U = np.uint64
#: Entries of the broadcast table of words, at most: 17 bytes each.
HEAD = 400_000
#: Words that a task holds before it counts them, about.
WORDS = 1 << 22
#: Of each word's training occurrences, how many count as an unseen word's.
DISCOUNT = 0.75
#: Classes: the end, then the most frequent words, then words by suffix, then pieces.
SINGLE, SUFFIX, PIECE = 48, 72, 8
CLASSES = SINGLE + SUFFIX + PIECE
#: Rows of the table that inputs are looked up in: classes, nothing (PAD), and pieces by their last byte.
INPUTS = 256
#: Contexts of a piece's first and second byte; the cells of both tables, the second byte may be none.
ROWS = 8192
FIRST = ROWS * 256
CELLS = FIRST + ROWS * 257
#: Cells whose counts go to the driver in one row.
BLOCK = 1 << 12
#: Weight of the byte's probability without context.
BACKOFF = 2.0
WIDTH, HIDDEN = 16, 16
CONTEXT, STRIDE = 32, 24
ROUNDS = 2
#: Subwords of a shard, about, and of a chunk of a text, at most.
SHARD = 1 << 21
CHUNK = 1 << 16
RATE = 0.005
FIT_BATCH, BATCH = 64, 96
END = 1 << 40
SEED = 5


# ---------------------------------------------------------------- words and subwords


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word, and the text that it is in."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if not len(data):
        none = np.empty(0, np.int64)
        return data, none, none, none
    solid = (data != 32) & (data - np.uint8(9) > 4)  # all others of white space are 9 to 13; below 9 it wraps around
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    full = sizes > 0
    start[begins[full]] = solid[begins[full]]
    stop[ends[full] - 1] = solid[ends[full] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return data, s, e, np.searchsorted(ends, s, side="right")


#: ``shingles._value`` of both bytes of each pair: looked up faster than byte by byte.
_values = np.stack([np.tile(sh._value, 256), np.repeat(sh._value, 256)], axis=1)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    up, down = sh._power(len(data) + 1)
    sums, even = np.zeros(len(data) + 1, U), len(data) & ~1
    np.take(_values, data[:even].view("<u2"), axis=0, out=sums[1 : even + 1].reshape(-1, 2), mode="clip")
    sums[even + 1 :] = sh._value[data[even:]]
    sums[1:] *= up[: len(data)]
    np.cumsum(sums, out=sums)
    return sh.mix((sums[e] - sums[s]) * down[s]).view(np.int64)


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _folded(data: np.ndarray) -> np.ndarray:
    """``_lower`` of all bytes, and a 0 after them."""
    out = np.zeros(len(data) + 1, np.uint8)
    np.left_shift((data - np.uint8(65) < 26).view(np.uint8), 5, out=out[:-1])
    out[:-1] += data
    return out


def _last_two(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A word's last two bytes, the first of them 0 if it has but one."""
    return np.where(e - s > 1, _lower[data[np.maximum(e - 2, 0)]], 0).astype(np.uint16) << 8 | _lower[data[e - 1]]


def _suffix(two: np.ndarray) -> np.ndarray:
    """A word's class if it isn't one of its own: by its last two bytes."""
    return (sh.mix(two.astype(U)) % U(SUFFIX)).astype(np.int8)


def suffix_class(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return _suffix(_last_two(data, s, e))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, where each is first, and how often it is."""
    found = pa.array(keys).dictionary_encode()
    number = found.indices.to_numpy()
    return found.dictionary.to_numpy(), np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)), np.bincount(number)


def grouped(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about ``shingles.GROUP`` bytes, with the place of the first."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > sh.GROUP:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b)
    if held:
        yield first, held


class Lookup:
    """Sorted keys; frequent ones are found through a direct-mapped table first."""

    BITS = 19

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.slot_key = np.full(1 << self.BITS, -1, np.int64)
        self.slot_at = np.zeros(1 << self.BITS, np.int64)
        by_count = np.argsort(counts[order], kind="stable")  # the most frequent is written last
        slots = self._slot(self.keys[by_count])
        self.slot_key[slots] = self.keys[by_count]
        self.slot_at[slots] = by_count
        self.order = order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(sh.BASE)) >> U(64 - self.BITS)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position in ``self.keys`` or -1."""
        slot = self._slot(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_at[slot], -1)
        open_ = np.flatnonzero(out < 0)
        if len(open_) and len(self.keys):
            at = np.searchsorted(self.keys, keys[open_])
            at[at == len(self.keys)] = 0
            out[open_] = np.where(self.keys[at] == keys[open_], at, -1)
        return out


@dataclass
class Vocabulary:
    """The table of frequent words: their counts and, of those in the vocabulary, class and log10 probability in it."""

    lookup: Lookup
    n: np.ndarray
    class_of: np.ndarray
    log_p: np.ndarray
    #: Training subwords of each class but those of pieces.
    mass: np.ndarray
    #: log10 (count + 0.5)
    logs: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, suffix: np.ndarray, ends: int) -> Vocabulary:
        look = Lookup(keys, counts)
        n, own = counts[look.order].astype(np.float64), SINGLE + suffix[look.order].astype(np.int64)
        held = np.flatnonzero(look.keys != END)
        first = held[np.lexsort((look.keys[held], -n[held]))[: SINGLE - 1]]
        own[first] = 1 + np.arange(len(first))
        left = n - DISCOUNT
        mass = np.bincount(own[held], weights=left[held], minlength=CLASSES)
        mass[0] = ends
        class_of = np.full(len(n), -1, np.int64)
        class_of[held] = own[held]
        log_p = np.zeros(len(n))
        log_p[held] = np.log10(left[held] / mass[own[held]])
        return Vocabulary(look, n, class_of, log_p, mass, np.log10(n + 0.5))


@dataclass
class Subwords:
    """Of a group of texts: class ids one after another with an end after each text, and what else their scores need."""

    classes: np.ndarray
    bounds: np.ndarray
    pieces: np.ndarray
    piece_bounds: np.ndarray
    #: To be scored only.  By text: words, those in the table, and the sums of log10 (count + 0.5) of these and of log10 probabilities in their classes.
    n_words: np.ndarray | None = None
    n_held: np.ndarray | None = None
    logs: np.ndarray | None = None
    inside: np.ndarray | None = None
    #: Hashes of words beyond the table.
    tail: np.ndarray | None = None
    tail_bounds: np.ndarray | None = None

    @staticmethod
    def both(texts: list[bytes], v: Vocabulary, keys: np.ndarray, trains: np.ndarray | None = None) -> tuple[Subwords, Subwords]:
        """To be scored, and to be fitted on: there some words, by the numbers ``keys`` of their texts, are spelled, and texts that don't train are empty."""
        data, s, e, text = spans(texts)
        hashes = word_hashes(data, s, e) if len(s) else np.empty(0, np.int64)
        words = (len(texts), _folded(data), s, e, text, hashes, v.lookup(hashes))
        fitted = words
        if trains is not None and not trains.all():
            own = trains[text]
            fitted = (*words[:2], *(x[own] for x in words[2:]))
        return Subwords.of(words, v), Subwords.of(fitted, v, keys)

    @staticmethod
    def of(words: tuple, v: Vocabulary, spell: np.ndarray | None = None) -> Subwords:
        k, folded, s, e, text, hashes, at = words
        known = at >= 0
        cls = np.where(known, v.class_of[at], -1) if len(v.n) else np.full(len(at), -1)
        if spell is not None and len(v.n):
            n = np.bincount(text, minlength=k)
            place = np.arange(len(s)) - (np.cumsum(n) - n)[text]
            chance = (sh.mix(spell[text] + place.astype(U) * U(sh.BASE)) >> U(11)) * 2.0**-53
            cls = np.where(known & (chance * v.n[at] < DISCOUNT), -1, cls)
        whole = cls >= 0
        each = np.where(whole, 1, (e - s + 1) >> 1)
        word = np.repeat(np.arange(len(s)), each)
        place = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
        units = cls[word]
        spelled = np.flatnonzero(units < 0)
        begin = s[word[spelled]] + 2 * place[spelled]
        one, pair = folded[begin].astype(np.int64), e[word[spelled]] - begin > 1
        starts = place[spelled] == 0
        units[spelled] = SINGLE + SUFFIX + 4 * starts + (one >> 6)
        before = np.where(starts, 0, folded[begin - 1].astype(np.int64) + 1)
        two = np.where(starts, 0, folded[begin - 2].astype(np.int64) + 1)
        row = lambda x, y: (sh.mix((x << 9 | y).astype(U)) % U(ROWS)).astype(np.int64)
        pieces = np.stack([row(two, before) * 256 + one, FIRST + row(two << 9 | before, one + 1) * 257 + np.where(pair, folded[begin + 1], 256)], axis=1)
        in_text = text[word]
        sizes = np.bincount(in_text, minlength=k)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        classes = np.zeros(len(units) + k, np.uint8)  # the end is class 0
        classes[np.arange(len(units)) + in_text] = units
        bounds_of = lambda x: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=k))])
        if spell is not None:
            return Subwords(classes, bounds, pieces.astype(np.int32), bounds_of(in_text[spelled]))
        logs = v.logs
        total = lambda values, of: np.bincount(of, weights=values, minlength=k).astype(np.float64)
        return Subwords(
            classes, bounds, pieces.astype(np.int32), bounds_of(in_text[spelled]),
            np.bincount(text, minlength=k), np.bincount(text[known], minlength=k), total(logs[at[known]], text[known]),
            total(v.log_p[at[whole]], text[whole]), hashes[~known], bounds_of(text[~known]),
        )


def cell_logs(counts: np.ndarray) -> np.ndarray:
    """For each cell the log10 probability of its byte in its context; of first bytes, among those with the same two highest bits, which the class tells."""

    def smooth(c: np.ndarray) -> np.ndarray:
        alone = c.sum(axis=0) + 0.5
        alone = alone / alone.sum(axis=-1, keepdims=True)
        return np.log10((c + BACKOFF * alone) / (c.sum(axis=-1, keepdims=True) + BACKOFF))

    first, second = counts[:FIRST].reshape(ROWS, 4, 64), counts[FIRST:].reshape(ROWS, 257)
    return np.concatenate([smooth(first).ravel(), smooth(second).ravel()]).astype(np.float32)


# ---------------------------------------------------------------- model


SHAPES = {
    "embed": (INPUTS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "near": (CONTEXT,), "up": (WIDTH, HIDDEN), "up_b": (HIDDEN,), "down": (HIDDEN, WIDTH), "out": (WIDTH, CLASSES), "out_b": (CLASSES,),
    "one": (WIDTH, 256), "two": (WIDTH, 257),
}
PAD = CLASSES
_distance = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
_causal = np.where(_distance >= 0, 0, -1e9).astype(np.float32)
_seen = np.flatnonzero(_distance >= 0)
_seen_at = _distance.ravel()[_seen]
_distance = np.maximum(_distance, 0)


def class_mass(v: Vocabulary, cells: np.ndarray) -> np.ndarray:
    """Training subwords of each class; the row of no bytes before is that of pieces which begin a word."""
    begin = int(sh.mix(np.zeros(1, U))[0] % U(ROWS))
    of = cells[:FIRST].reshape(ROWS, 4, 64).sum(axis=2)
    out = v.mass.astype(np.float64)
    out[SINGLE + SUFFIX + 4 :] += of[begin]
    out[SINGLE + SUFFIX : SINGLE + SUFFIX + 4] += of.sum(axis=0) - of[begin]
    return out


def fresh(mass: np.ndarray | None = None, seed: int = SEED) -> dict[str, np.ndarray]:
    """Before fitting each class has its share of ``mass``, one added, whatever the context, and bytes have theirs by ``cell_logs``."""
    r = np.random.default_rng(seed)
    out = {name: (r.normal(0, 0.5 / math.sqrt(WIDTH), shape) if len(shape) > 1 else np.zeros(shape)).astype(np.float32) for name, shape in SHAPES.items()}
    out["embed"] *= 2
    if mass is not None:
        for name in ("out", "one", "two"):
            out[name][:] = 0
        out["out_b"] = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
    return out


def piece_inputs(classes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The row of ``embed`` for each subword: its class, but a piece's by its last byte."""
    out = classes
    if len(cells):
        one, two = cells[:, 0] & 255, (cells[:, 1] - FIRST) % 257
        out = classes.copy()
        out[classes >= SINGLE + SUFFIX] = PAD + 1 + np.where(two < 256, two, one) % (INPUTS - PAD - 1)
    return out


def windows(classes: np.ndarray, bounds: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, CONTEXT), targets (n, STRIDE) and the target's place or -1, for texts whose subwords lie between ``bounds``.

    The last STRIDE places of a window predict; before a text stands the end's class.  ``own``: inputs where they aren't the classes.
    """
    sizes = np.diff(bounds)
    each = (sizes + STRIDE - 1) // STRIDE
    more = CONTEXT - STRIDE
    # each text at a multiple of STRIDE
    starts = (np.cumsum(each) - each) * STRIDE
    n = int(each.sum())
    at = np.arange(bounds[0], bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    place = np.full(n * STRIDE, -1, np.int64)
    place[at] = np.arange(bounds[0], bounds[-1])
    place = place.reshape(n, STRIDE)
    targets = np.zeros(n * STRIDE, classes.dtype)
    targets[at] = classes[bounds[0] : bounds[-1]]
    # what is read is one place later; a text's first window sees nothing before the end's class
    read = np.full((n + 1) * STRIDE + more, PAD, np.uint8)
    read[at + more + 1] = (classes if own is None else own)[bounds[0] : bounds[-1]]
    full = each > 0
    first = starts[full] // STRIDE
    inputs = read[(np.arange(n) * STRIDE)[:, None] + np.arange(CONTEXT)[None, :]]
    inputs[first, :more] = PAD
    inputs[first, more] = 0
    return inputs, targets.reshape(n, STRIDE), place


_ones = np.ones(1 << 13, np.float32)
#: The largest number whose exponential is taken as it is, and the least sum of a row's exponentials.
MOST, LEAST = 80.0, 1e-25


def _sums(a: np.ndarray) -> np.ndarray:
    """Over the last axis: for short rows a product is faster than a sum."""
    return a @ _ones[: a.shape[-1]].astype(a.dtype, copy=False)


def _exps(make: Callable[[], np.ndarray], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Exponentials of the rows of ``make()``, new each time, their sums, and of each row the number at ``own`` before.

    The largest number of each row is taken off only if one overflows or all of a row vanish: to find it takes longer than the exponentials.
    """
    x = make()
    if x.max(initial=0) < MOST:
        held = None if own is None else x[np.arange(len(x)), own]
        np.exp(x, out=x)
        sums = _sums(x)
        if sums.min(initial=1) > LEAST:
            return x, sums, held
        x = make()
    x -= x.max(axis=-1, keepdims=True)
    held = None if own is None else x[np.arange(len(x)), own]
    np.exp(x, out=x)
    return x, _sums(x), held


def forward(m: dict[str, np.ndarray], inputs: np.ndarray) -> dict[str, np.ndarray]:
    """Queries, keys and values are tables by input."""
    embed, at = m["embed"], inputs.astype(np.intp)
    own = at[:, CONTEXT - STRIDE :]
    tq, tk = embed @ m["q"] * (1 / math.sqrt(WIDTH)), embed @ m["k"]
    x, q, k, v = embed.take(at, 0), tq.take(own, 0), tk.take(at, 0), (embed @ m["v"]).take(at, 0)
    xq = x[:, CONTEXT - STRIDE :]
    near = m["near"][_distance] + _causal
    begins = np.flatnonzero(inputs[:, 0] == PAD)
    hidden = np.where(inputs[begins] == PAD, np.float32(-1e9), np.float32(0))[:, None, :]

    def asked() -> np.ndarray:
        a = q @ k.transpose(0, 2, 1)
        a += near
        a[begins] += hidden
        return a

    # a place sees itself, or the end before the text, so no sum of exponentials is empty
    a, sums, _ = _exps(asked)
    a /= sums[:, :, None]
    y = a @ v
    y += xq
    flat = y.reshape(-1, WIDTH)
    r = flat @ m["up"]
    r += m["up_b"]
    np.maximum(r, 0, out=r)
    z1 = np.empty((len(r), WIDTH + 1), r.dtype)  # and a one, for the bias
    z1[:, WIDTH] = 1
    z = np.add(r @ m["down"], flat, out=z1[:, :WIDTH])
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "y": flat, "r": r, "z": z, "z1": z1}


def class_odds(m: dict[str, np.ndarray], f: dict[str, np.ndarray], targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of what ``forward`` found: exponentials of the classes' log-odds, their sums, and the log-odds of ``targets``."""
    w = np.concatenate([m["out"], m["out_b"][None]])
    return _exps(lambda: f["z1"] @ w, None if targets is None else targets.ravel())


def byte_odds(m: dict[str, np.ndarray], z: np.ndarray, cells: np.ndarray, logs: np.ndarray, held: bool = True) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Of pieces in the order of ``Pieces``, predicted from ``z``: exponentials of the log-odds of the first byte, among those that the class leaves, and of the second, their sums, the log-odds of the byte, and which it is.

    ``logs``: natural logarithms of the cells' shares; ``held``: whether the log-odds of the byte are asked for.
    """
    one, (row, two) = cells[:, 0], np.divmod(cells[:, 1] - FIRST, 257)

    def first() -> np.ndarray:
        x = np.empty((len(z), 64), z.dtype)
        for at, w in _groups(one):
            x[at] = z[at] @ m["one"][:, w]
        x += logs[:FIRST].reshape(-1, 64).take(one >> 6, 0)
        return x

    def second() -> np.ndarray:
        x = z @ m["two"]
        x += logs[FIRST:].reshape(-1, 257).take(row, 0)
        return x

    for name, make, own in (("one", first, one & 63), ("two", second, two)):
        yield name, *_exps(make, own if held else None), own


def _group(one: np.ndarray) -> np.ndarray:
    """The two highest bits of a piece's first byte."""
    return ((one >> 6) & 3).astype(np.uint8)


def _groups(one: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Pieces by their group, in whose order they are, and the columns of ``one`` for the bytes that have these bits."""
    at = np.searchsorted(_group(one), _four)
    for k in range(4):
        if at[k + 1] > at[k]:
            yield slice(at[k], at[k + 1]), slice(64 * k, 64 * k + 64)


_four = np.arange(5, dtype=np.uint8)


def log_class(m: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, pieces: tuple[np.ndarray, np.ndarray] | None = None, logs: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each target's class; with ``pieces``, the places of piece targets and their cells, of its bytes too."""
    f = forward(m, inputs)
    _, sums, out = class_odds(m, f, targets)
    out -= np.log(sums)
    if pieces is not None and len(pieces[0]):
        at, cells = pieces
        for _, _, sums, held, _ in byte_odds(m, f["z"][at], cells, logs):
            out[at] += held - np.log(sums)
    return (out / math.log(10)).reshape(targets.shape)


def gradients(m: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, pieces: tuple[np.ndarray, np.ndarray] | None = None, logs: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the valid targets' classes and, with ``pieces``, of their bytes."""
    f = forward(m, inputs)
    b, s = targets.shape
    p, sums, _ = class_odds(m, f)
    share = valid.ravel().astype(p.dtype) / p.dtype.type(max(valid.sum(), 1))
    # rows of p aren't divided by their sums; what they are multiplied with is
    p[np.arange(len(p)), targets.ravel()] -= sums
    part = (share / sums)[:, None]
    out = (f["z1"] * part).T @ p
    g = {"out": out[:WIDTH], "out_b": out[WIDTH]}
    dz = p @ m["out"].T
    dz *= part
    if pieces is not None and len(pieces[0]):
        at, cells = pieces
        z, n, of = f["z"][at], np.arange(len(at)), share[at]
        more = np.zeros_like(z)
        for name, odds, sums, _, own in byte_odds(m, z, cells, logs, held=False):
            odds[n, own] -= sums
            part = (of / sums)[:, None]
            zs, w = z * part, m[name]
            if name == "two":
                g[name] = zs.T @ odds
                back = odds @ w.T
            else:
                g[name], back = np.zeros_like(w), np.empty_like(z)
                for i, c in _groups(cells[:, 0]):
                    g[name][:, c] = zs[i].T @ odds[i]
                    back[i] = odds[i] @ w[:, c].T
            back *= part
            more += back
        dz[at] += more
    else:
        g["one"], g["two"] = np.zeros_like(m["one"]), np.zeros_like(m["two"])
    dr = dz @ m["down"].T
    dr *= f["r"] > 0
    g["down"], g["up"], g["up_b"] = f["r"].T @ dz, f["y"].T @ dr, np.ones(len(dr), dr.dtype) @ dr
    dz += dr @ m["up"].T
    dy = dz.reshape(b, s, WIDTH)
    a = f["a"]
    dv = a.transpose(0, 2, 1) @ dy
    da = dy @ f["v"].transpose(0, 2, 1)
    da -= _sums(dy * (f["y"].reshape(b, s, WIDTH) - f["x"][:, CONTEXT - STRIDE :]))[:, :, None]  # what da gives on average over a
    da *= a
    g["near"] = np.bincount(_seen_at, weights=da.sum(axis=0).ravel()[_seen], minlength=CONTEXT).astype(p.dtype)
    dq, dk = da @ f["k"], da.transpose(0, 2, 1) @ f["q"]
    scale = p.dtype.type(1 / math.sqrt(WIDTH))
    x, xq, flat = f["x"].reshape(-1, WIDTH), f["x"][:, CONTEXT - STRIDE :].reshape(-1, WIDTH), lambda d: d.reshape(-1, WIDTH)
    g["q"], g["k"], g["v"] = xq.T @ flat(dq) * scale, x.T @ flat(dk), x.T @ flat(dv)
    dx = (flat(dk) @ m["k"].T + flat(dv) @ m["v"].T).reshape(b, CONTEXT, WIDTH)
    dx[:, CONTEXT - STRIDE :] += (flat(dq) @ (m["q"].T * scale)).reshape(b, s, WIDTH) + dy
    g["embed"] = _by_class(inputs, dx)
    return g


def _by_class(inputs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums by input: rows sorted by it, then added in runs."""
    flat, width = inputs.ravel(), values.shape[-1]
    n = np.bincount(flat, minlength=INPUTS)
    held = np.flatnonzero(n)
    out = np.zeros((INPUTS, width), values.dtype)
    out[held] = np.add.reduceat(values.reshape(-1, width).take(np.argsort(flat, kind="stable"), 0), (np.cumsum(n) - n)[held], axis=0)
    return out


class Adam:
    """Steps on a copy of a model, ``m``, whose arrays lie in one."""

    def __init__(self, m: dict[str, np.ndarray], rate: float):
        self.rate, self.t, self.flat = rate, 0, _flat(m)
        self.m = _views(self.flat)
        self.one, self.two = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.held = np.empty_like(self.flat)

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        g_, held = _flat(g), self.held
        self.one *= 0.9
        self.one += np.multiply(g_, 0.1, out=held)
        self.two *= 0.99
        g_ *= held
        g_ *= 0.1  # 0.01 of the squares
        self.two += g_
        np.sqrt(self.two, out=held)
        held *= 1 / math.sqrt(1 - 0.99**self.t)
        held += 1e-8
        np.divide(self.one, held, out=held)
        held *= self.rate / (1 - 0.9**self.t)
        self.flat -= held


class Pieces:
    """Which subwords of a sequence are pieces, and their cells, in the order of their groups."""

    def __init__(self, classes: np.ndarray, cells: np.ndarray):
        self.cells = cells
        self.number = np.cumsum(classes >= SINGLE + SUFFIX) - 1 if len(cells) else None

    def __call__(self, targets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        if self.number is None:
            return None
        at = np.flatnonzero((targets >= SINGLE + SUFFIX) & (place >= 0))
        cells = self.cells.take(self.number[place.ravel()[at]], 0)
        order = np.argsort(_group(cells[:, 0]), kind="stable")
        return at[order], cells.take(order, 0)


def fit_chunks(m: dict[str, np.ndarray], chunks: Iterator[tuple[bytes, bytes]], logs: np.ndarray | None = None, rate: float = RATE) -> tuple[dict[str, np.ndarray], int]:
    """``m`` fitted on all windows of ``chunks``, classes and cells of pieces, in their order, and how many there were."""
    adam, seen = Adam(m, rate), 0
    held: list[tuple[bytes, bytes]] = []
    size = 0

    def step() -> None:
        classes = np.frombuffer(b"".join(c for c, _ in held), np.uint8)
        cells = np.frombuffer(b"".join(p for _, p in held), np.int32).reshape(-1, 2)
        pieces = Pieces(classes, cells)
        inputs, targets, place = windows(classes, np.cumsum([0, *(len(c) for c, _ in held)]), piece_inputs(classes, cells))
        batches = max(round(len(inputs) / FIT_BATCH), 1)
        for i in range(batches):
            w = slice(len(inputs) * i // batches, len(inputs) * (i + 1) // batches)
            adam.step(gradients(adam.m, inputs[w], targets[w], place[w] >= 0, pieces(targets[w], place[w]), logs))

    for c in chunks:
        if len(c[0]):
            held.append(c)
            size += -(-len(c[0]) // STRIDE)
        if size >= 16 * FIT_BATCH:
            step()
            held, seen, size = [], seen + size, 0
    if size:
        step()
    return adam.m, seen + size


# ---------------------------------------------------------------- Spark


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), "text")


def count(docs: DataFrame) -> DataFrame:
    """(key, n, suffix) of words, by hash, over training texts; the end of a text has the key ``END``."""

    def rows(held: list[np.ndarray], twos: list[np.ndarray], ends: int) -> Iterator[pa.RecordBatch]:
        keys, at, n = _counted(np.concatenate(held)) if held else (np.empty(0, np.int64),) * 3
        suffix = _suffix(np.concatenate(twos)[at]) if held else np.empty(0, np.int8)
        keys, n, suffix = np.append(keys, END), np.append(n, ends), np.append(suffix, np.int8(0))
        for i in range(0, len(keys), 1 << 17):
            w = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(keys[w]), pa.array(n[w].astype(np.int64)), pa.array(suffix[w])], ["key", "n", "suffix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, twos, ends, words = [], [], 0, 0
            for _, texts in grouped(texts_of(b)):
                data, s, e, _text = spans(texts)
                ends += len(texts)
                if len(s):
                    held.append(word_hashes(data, s, e))
                    twos.append(_last_two(data, s, e))
                    words += len(s)
                if words >= WORDS:
                    yield from rows(held, twos, ends)
                    held, twos, ends, words = [], [], 0, 0
            yield from rows(held, twos, ends)

    found = _read(docs).where(~F.col("held_out")).select("text").mapInArrow(run, "key long, n long, suffix byte")
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.min("suffix").alias("suffix"))


def head(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and suffix classes of the most frequent, at most ``most``: those over the lowest count at which they fit."""
    band = F.floor(F.log2("n") * 8)
    held, least = 0, 1
    for r in sorted(counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("n")).collect(), key=lambda r: -r["band"]):
        held += r["keys"]  # a row for each band of counts: a few hundred at most
        if held > most:
            break
        least = r["n"]
    else:
        least = 1
    if held > most and least == 1:
        least = 1 << 62
    t = counts.where(F.col("n") >= least).select("key", "n", "suffix").toArrow()
    return t["key"].to_numpy(), t["n"].to_numpy(), t["suffix"].to_numpy()


def _flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in SHAPES])


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = math.prod(shape)
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _chunked(classes: np.ndarray) -> list[int]:
    """How many pieces stand before each chunk of a text after its first; most texts have but one."""
    if len(classes) <= CHUNK:
        return []
    return np.cumsum(classes >= SINGLE + SUFFIX)[CHUNK - 1 : len(classes) - 1 : CHUNK].tolist()


def sequences(docs: DataFrame, vocabulary) -> DataFrame:
    """For each row of ``docs`` its class ids, a byte each, its pieces, both again as a training text is fitted on, and the parts of its scores that come from the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in batches:
            for first, texts in grouped(texts_of(b)):
                key, n = np.array([xxhash.xxh64_intdigest(t) for t in texts], U), len(texts)
                trains = ~np.asarray(b.column("held_out").slice(first, n).to_pylist(), bool)
                x, y = Subwords.both(texts, v, key, trains)
                cut_ = lambda a, at: pa.array([a[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                tail = pa.ListArray.from_arrays(pa.array(x.tail_bounds.astype(np.int32)), pa.array(x.tail))
                fitted = [pc.if_else(pa.array(trains), a, pa.nulls(n, pa.binary())) for a in (cut_(y.classes, y.bounds), cut_(y.pieces, y.piece_bounds))]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(first, n) for c in ("row", "doc_id", "held_out")), _signed(key), pa.array(x.n_words + 1), pa.array(x.n_held.astype(np.int64)), pa.array(x.logs), pa.array(x.inside), cut_(x.classes, x.bounds), cut_(x.pieces, x.piece_bounds), *fitted, pa.array([_chunked(c) for c in np.split(y.classes, y.bounds[1:-1])], pa.list_(pa.int32())), tail],
                    ["row", "doc_id", "held_out", "key", "n_tokens", "n_held", "logs", "inside", "classes", "pieces", "fit_classes", "fit_pieces", "fit_at", "tail"],
                )

    read = _read(docs).withColumn("row", F.monotonically_increasing_id())
    return read.mapInArrow(run, "row long, doc_id long, held_out boolean, key long, n_tokens long, n_held long, logs double, inside double, classes binary, pieces binary, fit_classes binary, fit_pieces binary, fit_at array<int>, tail array<long>")


def cell_counts(train: DataFrame) -> np.ndarray:
    """Of all cells, over training texts: as many numbers as there are cells.  Tasks give a row for each block of cells, not for each cell."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield np.frombuffer(b"".join(b.column("pieces").slice(i, 256).to_pylist()), np.int32)

    def rows(n: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, x in n.items():
            some = np.flatnonzero(x)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([some.astype(np.int32).tobytes()]), pa.array([x[some].tobytes()])], ["block", "cells", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(-(-CELLS // BLOCK) * BLOCK, np.int64)
        for x in sums(batches):
            np.add.at(n, x, 1)
        yield from rows(dict(enumerate(n.reshape(-1, BLOCK))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for b in batches:
            for block, cells, more in zip(*(b.column(c).to_pylist() for c in ("block", "cells", "n")), strict=True):
                n.setdefault(block, np.zeros(BLOCK, np.int64))[np.frombuffer(cells, np.int32)] += np.frombuffer(more, np.int64)
        yield from rows(n)

    schema = "block long, cells binary, n binary"
    counted = train.where(F.octet_length("pieces") > 0).select("pieces").mapInArrow(count, schema)
    out = np.zeros(-(-CELLS // BLOCK) * BLOCK)
    for r in counted.repartition("block").mapInArrow(add, schema).toArrow().to_pylist():  # a row for each block
        out[r["block"] * BLOCK + np.frombuffer(r["cells"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out[:CELLS]


def fit(train: DataFrame, mass: np.ndarray, rounds: int = ROUNDS, shard: int = SHARD, rate: float = RATE, logs: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Federated averaging over rows (key, classes) or, with ``logs`` for the bytes of pieces, (key, classes, pieces, at): see the module's docstring."""
    m = fresh(mass)
    sc = train.sparkSession.sparkContext
    total = train.agg(F.coalesce(F.sum(F.octet_length("classes").cast("long")), F.lit(0))).first()[0]  # one number
    if not total or rounds < 1:
        return m
    shards = max(round(total / rounds / shard), 1)
    # chunks of a text come in its order; after the first they begin without a context
    chunks = train.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("classes") - 1) / CHUNK).cast("int"))))
    dealt = F.xxhash64("key", "chunk")
    if logs is not None:
        first = F.coalesce(F.try_element_at("at", F.when(F.col("chunk") > 0, F.col("chunk"))), F.lit(0))
        last = F.coalesce(F.try_element_at("at", F.col("chunk") + 1), F.floor(F.octet_length("pieces") / 8).cast("int"))
    pieces = F.substring("pieces", first * 8 + 1, (last - first) * 8) if logs is not None else F.lit(b"")
    chunks = chunks.select("key", "chunk", pieces.alias("pieces"), F.substring("classes", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("classes"), F.pmod(dealt, F.lit(rounds)).alias("pass"), F.pmod(F.shiftright(dealt, 16), F.lit(shards)).alias("shard"))
    known = sc.broadcast(logs)
    for number in range(rounds):
        held = sc.broadcast(m)  # one small model

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            state: dict = {}

            def rows() -> Iterator[tuple[int, tuple[bytes, bytes]]]:
                for b in batches:
                    for i in range(0, b.num_rows, 256):
                        part = b.slice(i, 256)
                        yield from zip(part.column("shard").to_pylist(), zip(part.column("classes").to_pylist(), part.column("pieces").to_pylist(), strict=True), strict=True)

            stream = rows()
            state["next"] = next(stream, None)

            def one_shard(own: int) -> Iterator[tuple[bytes, bytes]]:
                while state["next"] is not None and state["next"][0] == own:
                    yield state["next"][1]
                    state["next"] = next(stream, None)

            while state["next"] is not None:
                fitted, seen = fit_chunks(held.value, one_shard(state["next"][0]), known.value, rate)
                flat = _flat(fitted).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, seen))], ["i", "x"])

        part = chunks.where(F.col("pass") == number).select("shard", "key", "chunk", "classes", "pieces")
        ordered = part.repartition(shards, "shard").sortWithinPartitions("shard", "key", "chunk", "classes")
        sums = ordered.select("shard", "classes", "pieces").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
        got = sums.toArrow().sort_by("i")["x"].to_numpy()  # as many rows as the model has numbers
        if len(got) and got[-1]:
            m = _views((got[:-1] / got[-1]).astype(np.float32))
    return m


def lm_score(docs: DataFrame, rounds: int = ROUNDS, shard: int = SHARD, most: int = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Null and empty texts are the end alone; repeated rows count and are scored
    each; without training texts every token is unknown (N = V = 0) and the
    model is the untrained one; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    counts = cut(count(docs))
    n_all, v_all, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("key") == END, F.col("n"))), F.lit(0))).first()  # one row
    vocabulary = Vocabulary.of(*head(counts, most), ends)
    known = sc.broadcast(vocabulary)
    seqs, _ = stored(sequences(docs, known))
    train = seqs.where("fit_classes IS NOT NULL").select("key", F.col("fit_classes").alias("classes"), F.col("fit_pieces").alias("pieces"), F.col("fit_at").alias("at"))
    cells = cell_counts(train)
    shares = cell_logs(cells) * np.float32(math.log(10))
    model = sc.broadcast((fit(train, class_mass(vocabulary, cells), rounds, shard, logs=shares), shares))
    scale = math.log10(n_all + 0.5 * (v_all + 1))
    end_log = math.log10(ends + 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = model.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                held = [np.frombuffer(x, np.uint8) for x in part.column("classes").to_pylist()]
                spelled = part.column("pieces").to_pylist()
                out = np.zeros(len(held))
                for first, last in _runs([len(x) for x in held]):
                    classes, bounds = np.concatenate(held[first:last]), np.concatenate([[0], np.cumsum([len(x) for x in held[first:last]])])
                    cells = np.frombuffer(b"".join(spelled[first:last]), np.int32).reshape(-1, 2)
                    pieces, score = Pieces(classes, cells), np.zeros(len(classes))
                    inputs, targets, place = windows(classes, bounds, piece_inputs(classes, cells))
                    found = [log_class(m, inputs[j : j + BATCH], targets[j : j + BATCH], pieces(targets[j : j + BATCH], place[j : j + BATCH]), logs) for j in range(0, len(inputs), BATCH)]
                    score[place[place >= 0]] = np.concatenate(found)[place >= 0]
                    out[first:last] = np.add.reduceat(score, bounds[:-1])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_held", "logs")), pa.array(out + part.column("inside").to_numpy())], ["row", "doc_id", "held_out", "n_tokens", "n_held", "logs", "score"])

    scored = seqs.select("row", "doc_id", "held_out", "n_tokens", "n_held", "logs", "inside", "classes", "pieces").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_held long, logs double, score double")
    rest = seqs.where(F.size("tail") > 0).select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    found = rest.join(counts.select("key", "n"), "key", "left").groupBy(F.col("row").alias("tail_row"))
    found = found.agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_logs"))
    out = scored.join(found, F.col("row") == F.col("tail_row"), "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.coalesce("more", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )


def _runs(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` subwords together; a longer text is a run of its own."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if sizes:
        yield first, len(sizes)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))
