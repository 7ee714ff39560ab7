"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: the word's, that
of its first four letters and that of its first six.  Filters of several widths
slide over the words, each keeps its largest response in the whole text, and a
logistic layer scores the maxima.

The classifier is fitted on every labelled row outside the held-out fold and the
calibrated fifth.  It starts on the driver, on a bounded number of rows
(``SAMPLE``); if there are more, ``ROUNDS`` passes follow in which shards of about
``SHARD`` rows, dealt by a hash, each go on from the same model over all of their
rows.  Their models are averaged: a row of the table by how many batches had its
words, the rest by the number of rows.  Thresholds by language are calibrated on
every row of that fifth, from counts of scores; they give the column ``flagged``
and never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandgraph.llm import shingles as sh
from strandgraph.llm.common import cut, documents, texts_of

BUCKETS = 1 << 16
WIDTH = 16
FILTERS = {1: 16, 2: 8, 3: 8}
#: Labelled rows that fitting starts on, at most, and of those with label 1; all sources and languages alike by hash.
SAMPLE = 8000
#: Bytes of these texts together, at most, summed up in Spark in the order of the hashes before any text is read:
#: bounds the driver's memory.  The ids from the first that doesn't fit come in the passes, and so do texts larger than this.
SAMPLE_BYTES = 40_000_000
#: Passes over all labelled rows, and rows of a shard, about.
ROUNDS = 2
SHARD = 8192
#: Texts that fitting visits at its start: enough rounds over a small sample, and no fewer than EPOCHS over a large one.
VISITS = 40_000
EPOCHS = 4
BATCH = 32
SEED = 11
#: Size of the bitmap of labelled ids.
BITS = 1 << 26
#: Log-odds of scores are counted in steps of one by ``GRID``.
GRID = 64
#: Code points that are worked on at once, about, and words.
GROUP = 1 << 16
WORDS = 1 << 15

U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    """By code point: whether it is in a word (a letter or a digit), and a well-mixed number."""
    if not _tables:
        n = 0x110000
        _tables["inside"] = np.fromiter((chr(c).isalnum() for c in range(n)), bool, n)
        _tables["value"] = sh.mix(np.arange(1, n + 1, dtype=U)) | U(1)
    return _tables[name]


def _rows_of_group(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _table("inside")[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    s, e = edges[::2], edges[1::2]
    up, down = sh._power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_table("value")[data] * up[: len(data)], out=sums[1:])
    text = np.searchsorted(ends, s, side="right")
    n = np.bincount(text, minlength=len(texts))
    bounds = np.append(0, np.cumsum(np.maximum(n, 1)))
    rows = np.zeros((bounds[-1], 3), np.uint16)  # a text without words has one word of row 0
    at = np.arange(len(s)) + np.cumsum(n == 0)[text]
    for j, most in enumerate((None, 4, 6)):
        end = e if most is None else np.minimum(e, s + most)
        rows[at, j] = U(1) + sh.mix((sums[end] - sums[s]) * down[s] + U(j)) % U(BUCKETS - 1)
    return rows, bounds


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``GROUP`` code points that end where no word goes on."""
    first = 0
    while first < len(text):
        last = first + GROUP
        while last < len(text) and text[last - 1].isalnum():
            last += 1
        yield text[first:last]
        first = last


def rows_of_texts(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts, (words, 3) rows of the table and the bounds of each text; a long text is a group of its own."""
    held: list[str] = []
    size = 0
    for t in texts:
        low = t.lower() if t else ""
        if held and size + len(low) > GROUP:
            yield _rows_of_group(held)
            held, size = [], 0
        if len(low) > GROUP:
            parts = [r for r, _ in map(_rows_of_group, ([p] for p in _parts(low)))]
            rows = np.concatenate(parts)
            if len(parts) > 1:
                rows = rows[rows[:, 0] > 0]  # parts without words
            rows = rows if len(rows) else np.zeros((1, 3), np.uint16)
            yield rows, np.array([0, len(rows)])
            continue
        held.append(low)
        size += len(low) + 1
    if held:
        yield _rows_of_group(held)


def rows_of(text: str | None) -> np.ndarray:
    """(words, 3) rows of the table; a text without words has one word of row 0."""
    return next(rows_of_texts([text]))[0]


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (places, WIDTH, filters)
    shift: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
        table[0] = 0
        return Model(
            table,
            {w: r.normal(0, 1 / np.sqrt(w * WIDTH), (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS.items()},
            {w: np.zeros(n, np.float32) for w, n in FILTERS.items()},
            np.abs(r.normal(0, 0.3, sum(FILTERS.values()))).astype(np.float32),
            -1.0,
        )

    def maxima(self, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """The largest response of each filter, and where it is; shorter texts are padded with empty words."""
        x = self.table[rows].sum(axis=1)
        top, where = [], []
        for w, f in self.filters.items():
            padded = np.concatenate([x, np.zeros((w - 1, WIDTH), np.float32)]) if w > 1 else x
            n = len(x)
            y = sum(padded[k : k + n] @ f[k] for k in range(w)) + self.shift[w]
            at = y.argmax(axis=0)
            top.append(np.maximum(y[at, np.arange(y.shape[1])], 0))
            where.append((w, at, padded))
        return np.concatenate(top), where, x

    def _responses(self, rows: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
        """The response of each filter at each word of texts one after another, without shifts."""
        x = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        out = {}
        for w, f in self.filters.items():
            y = out[w] = x @ f[0]
            for k in range(1, w):
                part = x @ f[k]
                for j in range(k):  # places that follow on words of the text before
                    part[np.minimum(bounds[:-1] + j, bounds[1:] - 1)] = 0
                y[:-k] += part[k:]
        return out

    def peaks(self, rows: np.ndarray, bounds: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """For each text the largest response of each filter, without shifts, and the first word that has it, if asked for."""
        count = len(bounds) - 1
        if count > 1 and len(rows) > WORDS:
            runs = [(int(a), int(a) + 1) for a in range(count)]
            parts = [self.peaks(rows[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], places) for a, b in runs]
            return np.concatenate([p for p, _ in parts]), np.concatenate([at + bounds[a] for (_, at), (a, _) in zip(parts, runs, strict=True)]) if places else None
        if len(rows) > 2 * WORDS:  # one long text, in parts that see the words after their last
            more = max(self.filters) - 1
            best, found = None, None
            for first in range(0, len(rows), WORDS):
                part = rows[first : first + WORDS + more]
                top, at = self._peaks({w: y[:WORDS] for w, y in self._responses(part, np.array([0, len(part)])).items()}, np.array([0, min(WORDS, len(part))]), places)
                if best is None:
                    best, found = top, at
                    continue
                if places:
                    found = np.where(top > best, at + first, found)
                best = np.maximum(best, top)
            return best, found
        return self._peaks(self._responses(rows, bounds), bounds, places)

    @staticmethod
    def _peaks(ys: dict[int, np.ndarray], bounds: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
        tops, found = [np.maximum.reduceat(y, bounds[:-1], axis=0) for y in ys.values()], []
        for y, top in zip(ys.values(), tops, strict=True) if places else ():
            at, f = np.nonzero(y == np.repeat(top, np.diff(bounds), axis=0))
            text = np.searchsorted(bounds, at, side="right") - 1
            _, first = np.unique(text * y.shape[1] + f, return_index=True)
            found.append(at[first].reshape(top.shape))
        return np.concatenate(tops, axis=1), np.concatenate(found, axis=1) if places else None

    def top(self, peaks: np.ndarray) -> np.ndarray:
        return np.maximum(peaks + np.concatenate(list(self.shift.values())), 0)

    def log_odds(self, maxima: np.ndarray) -> np.ndarray:
        return np.clip(maxima @ self.out + self.bias, -30, 30)

    def score(self, maxima: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(maxima)))


class Fitting:
    """Adagrad on the logistic loss, from a copy of a model."""

    def __init__(self, m: Model, rate: float = 0.05):
        self.m = Model(m.table.copy(), {w: f.copy() for w, f in m.filters.items()}, {w: x.copy() for w, x in m.shift.items()}, m.out.copy(), m.bias)
        self.rate = rate
        self.seen_table = np.full(BUCKETS, 1e-3, np.float32)
        self.seen = {id(a): np.full(a.shape, 1e-3, np.float32) for a in (*self.m.filters.values(), *self.m.shift.values(), self.m.out)}
        self.seen_bias = 1e-3
        #: Batches that changed a row of the table.
        self.hits = np.zeros(BUCKETS, np.int64)

    def _move(self, a: np.ndarray, g: np.ndarray) -> None:
        s = self.seen[id(a)]
        s += g * g
        a -= self.rate * g / np.sqrt(s)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        """One batch of (words, 3) rows."""
        m, count = self.m, len(texts)
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        rows = np.concatenate(texts)
        peaks, best = m.peaks(rows, bounds, places=True)
        top = m.top(peaks)
        d = (weights * (m.score(top) - labels) / count).astype(np.float32)
        g_out, g_bias = d @ top, float(d.sum())
        back, k = d[:, None] * m.out * (top > 0), 0
        g_f, g_s, hit_rows, hit_grads = {}, {}, [], []
        for w, f in m.filters.items():
            n = f.shape[2]
            g, at = back[:, k : k + n], best[:, k : k + n]
            k += n
            g_s[w], g_f[w] = g.sum(axis=0), np.zeros_like(f)
            for place in range(w):
                inside = at + place < bounds[1:, None]
                word = rows[(at + place)[inside]]
                got = np.zeros((count, n, WIDTH), np.float32)
                got[inside] = m.table[word].sum(axis=1)
                g_f[w][place] = np.einsum("bnd,bn->dn", got, g)
                hit_rows.append(word.ravel())
                hit_grads.append(np.repeat((g[:, :, None] * f[place].T)[inside], 3, axis=0))
        changed, inverse = np.unique(np.concatenate(hit_rows), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        g_t = np.add.reduceat(np.concatenate(hit_grads)[order], np.searchsorted(inverse[order], np.arange(len(changed))), axis=0)
        self.seen_table[changed] += (g_t * g_t).mean(axis=1)
        m.table[changed] -= self.rate * g_t / np.sqrt(self.seen_table[changed])[:, None]
        m.table[0] = 0
        self.hits[changed] += 1
        for w in m.filters:
            self._move(m.filters[w], g_f[w])
            self._move(m.shift[w], g_s[w])
        self._move(m.out, g_out)
        np.maximum(m.out, 0, out=m.out)  # a response is evidence of toxicity or none, so clean words in a long text can't hide a toxic one
        self.seen_bias += g_bias * g_bias
        m.bias -= self.rate * g_bias / np.sqrt(self.seen_bias)


def label_weights(n0: int, n1: int) -> np.ndarray:
    """Of a row with label 0 and of one with label 1: both labels weigh the same, up to a bound."""
    return np.clip([0.5 * (n0 + n1) / max(n0, 1), 0.5 * (n0 + n1) / max(n1, 1)], 0, 10).astype(np.float32)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.05) -> Model:
    """A model fitted from the start.  Without both labels the score is their share."""
    m, r = Model.fresh(seed), np.random.default_rng(seed)
    n1 = int(labels.sum())
    if not n1 or n1 == len(labels):
        m.out[:] = 0
        m.bias = 2.0 if n1 else -2.0
        return m
    weight = label_weights(len(labels) - n1, n1)[labels]
    fitting = Fitting(m, rate)
    for _ in range(max(epochs, min(60, VISITS // len(texts)))):
        order = r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            fitting.step([texts[i] for i in batch], labels[batch], weight[batch])
    return fitting.m


def logit(score: float) -> float:
    return float(np.log(score / (1 - score)))


def best_threshold(steps: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next lower score in log-odds; 0.5 without both labels.

    ``steps`` are the different log-odds in steps of the grid, ``n`` the rows with each and ``hits`` those with label 1.
    """
    if not hits.sum() or hits.sum() == n.sum():
        return 0.5
    order = np.argsort(-steps)
    s, found = steps[order], np.cumsum(hits[order])
    k = int(np.argmax(2 * found / (np.cumsum(n[order]) + hits.sum())))
    lower = s[k + 1] if k + 1 < len(s) else s[k] - 2 * GRID
    return float(1 / (1 + np.exp(-(s[k] + lower) / 2 / GRID)))


def bucket(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _dense(m: Model) -> np.ndarray:
    """Filters, shifts, outputs and bias in rows as wide as the table's."""
    flat = np.concatenate([*(f.ravel() for f in m.filters.values()), *m.shift.values(), m.out, [m.bias]])
    return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)


def _averaged(m: Model, at: np.ndarray, means: np.ndarray) -> Model:
    """``m`` with the rows ``at`` of its table, or beyond it of ``_dense``, replaced."""
    out = Fitting(m).m
    inside = at < BUCKETS
    out.table[at[inside]] = means[inside]
    flat = means[~inside][np.argsort(at[~inside])].ravel()
    place = 0
    for a in (*out.filters.values(), *out.shift.values(), out.out) if len(flat) else ():
        a[...] = flat[place : place + a.size].reshape(a.shape)
        place += a.size
    out.bias = float(flat[place]) if len(flat) else m.bias
    return out


def fit_shards(held: DataFrame, m: Model, weights: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``m`` after passes over (shard, y, rows), whose shards lie together, each in one partition.

    What reaches the driver has the size of one model, whatever the number of rows.
    """
    sc = held.sparkSession.sparkContext
    for _ in range(rounds):
        known = sc.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            def examples() -> Iterator[tuple[int, int, np.ndarray]]:
                for b in batches:
                    for i in range(0, b.num_rows, BATCH):
                        part = b.slice(i, BATCH)
                        for shard, y, x in zip(part.column("shard").to_pylist(), part.column("y").to_pylist(), part.column("rows").to_pylist(), strict=True):
                            yield shard, y, np.frombuffer(x, np.uint16).reshape(-1, 3)

            stream = examples()
            after = next(stream, None)
            while after is not None:
                own, fitting, seen = after[0], Fitting(known.value), 0
                while after is not None and after[0] == own:
                    batch = []
                    while after is not None and after[0] == own and len(batch) < BATCH:
                        batch.append(after)
                        after = next(stream, None)
                    y = np.array([b[1] for b in batch])
                    fitting.step([b[2] for b in batch], y, weights[y])
                    seen += len(batch)
                changed = np.flatnonzero(fitting.hits)
                dense = _dense(fitting.m)
                weight = np.append(fitting.hits[changed], np.full(len(dense), seen))
                sums = np.concatenate([fitting.m.table[changed], dense]).astype(np.float64) * weight[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(changed, BUCKETS + np.arange(len(dense)))), pa.array(weight), *map(pa.array, np.ascontiguousarray(sums.T))], ["at", "weight", *names])

        names = [f"x{j}" for j in range(WIDTH)]
        part = held.select("shard", "y", "rows").mapInArrow(run, "at long, weight long, " + ", ".join(f"{x} double" for x in names))
        got = part.groupBy("at").agg(F.sum("weight").alias("weight"), *(F.sum(x).alias(x) for x in names)).toArrow()
        m = _averaged(m, got["at"].to_numpy(), np.stack([got[x].to_numpy() for x in names], axis=1) / got["weight"].to_numpy()[:, None])
    return m


def marked(told: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of labelled ids: of fixed size; what it lets through is joined exactly afterwards."""
    at = F.pmod("h", F.lit(BITS))
    got = told.groupBy(F.shiftright(at, 15).alias("at")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).toArrow()
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for at_, bits in zip(got["at"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[at_] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def prepared(docs: DataFrame, told: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, h, y, calibrates, lang, size, rows) of each row of ``docs`` that ``told`` has: a shard lies in one partition, in the order of the hashes.

    Table rows of words are shuffled once, texts never; an id's label is found among the rows of its shard.
    """
    bits = docs.sparkSession.sparkContext.broadcast(marked(told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("h").to_numpy() % BITS
            b = b.filter(pa.array((bits.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            first = 0
            for rows, bounds in rows_of_texts(texts_of(b)):
                n = len(bounds) - 1
                cut_ = pa.array([rows[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, n) for c in ("id", "h", "lang", "size")), cut_], ["id", "h", "lang", "size", "rows"])
                first += n

    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    read = docs.where(id_.isNotNull() & (bucket(F.col("doc_id")) != 0))
    read = read.select(id_.alias("id"), F.xxhash64(id_, F.lit(seed)).alias("h"), F.coalesce("lang", F.lit("")).alias("lang"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    found = read.mapInArrow(run, "id long, h long, lang string, size long, rows binary").withColumn("y", F.lit(None).cast("int"))
    shards = max(round(told.count() / shard), 1)
    both = found.unionByName(told.select("id", "h", "y"), allowMissingColumns=True).withColumn("shard", F.pmod(F.shiftright("h", 32), F.lit(shards)).cast("int"))
    own = F.max("y").over(W.partitionBy("shard", "id"))
    both = both.repartition(shards, "shard").withColumn("y", own).where("rows IS NOT NULL AND y IS NOT NULL")
    out = both.select("shard", "h", "y", (F.pmod("h", F.lit(5)) == 4).alias("calibrates"), "lang", "size", "rows")
    return cut(out.sortWithinPartitions("shard", "h", "rows"))


def calibrated(m: Model, rows: DataFrame) -> Model:
    """``m`` with the score 0.5 put where F1 is best over all (lang, y, rows), and the best threshold of each language with 40 rows."""
    known = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odds = [float(known.value.log_odds(known.value.top(known.value.peaks(x, np.array([0, len(x)]))[0]))[0]) for x in (np.frombuffer(x.as_py(), np.uint16).reshape(-1, 3) for x in b.column("rows"))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(np.rint(np.array(odds) * GRID).astype(np.int64))], ["lang", "y", "step"])

    got = rows.select("lang", "y", "rows").mapInArrow(run, "lang string, y int, step long").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    got = got.toArrow()  # at most 60 * GRID + 1 rows for each language
    lang, step, n, hits = (got[c].to_numpy() for c in ("lang", "step", "n", "hits"))
    steps, at = np.unique(step, return_inverse=True)
    total = lambda x: np.bincount(at, weights=x, minlength=len(steps))
    best = logit(min(max(best_threshold(steps, total(n), total(hits)), 1e-6), 1 - 1e-6)) if len(steps) else 0.0
    m.bias -= best
    m.thresholds = {g: best_threshold(step[lang == g] - best * GRID, n[lang == g], hits[lang == g]) for g in sorted(set(lang)) if n[lang == g].sum() >= 40}
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, most: int = SAMPLE_BYTES, rounds: int = ROUNDS, shard: int = SHARD) -> Model:
    """Fit on all labelled rows outside the held-out fold; a fifth of them calibrates the thresholds instead.

    Fitting starts on the ``sample`` ids with the lowest hash, half of them with label 1 if there are so many,
    as far as ``most`` bytes of text go.  If that isn't all, passes over all rows follow.
    """
    told = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    told = told.where(bucket(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    told = told.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("calibrates", F.pmod("h", F.lit(5)) == 4)
    all_ = prepared(docs, told, shard, seed)
    fits = all_.where("NOT calibrates")
    n = {r["y"]: r["n"] for r in fits.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    parts = [told.where(F.col("y") == y).where("NOT calibrates").orderBy("h", "id").limit(sample // 2).select("h") for y in (0, 1)]
    picked = F.broadcast(parts[0].union(parts[1]))  # at most `sample` rows
    read = fits.join(picked, "h").where(F.col("size") <= most)
    sizes = cut(read.groupBy("h").agg(F.sum("size").alias("size")))  # a row for each picked id
    within = F.sum("size").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, 0)) <= most
    held = F.broadcast(cut(sizes.select("h", within.alias("within")).where("within").select("h")))
    rows = read.join(held, "h").select("y", "h", "rows").toArrow().sort_by([("h", "ascending"), ("rows", "ascending")])
    y = np.array(rows["y"].to_pylist(), dtype=np.int64)
    m = fit([np.frombuffer(x.as_py(), np.uint16).reshape(-1, 3) for x in rows["rows"]], y, seed=seed)
    if len(y) < sum(n.values()):
        if len(n) == 2:
            m = fit_shards(fits, m if 0 < y.sum() < len(y) else Model.fresh(seed), label_weights(n[0], n[1]), rounds)
        elif not len(y):
            m.bias = 2.0 if 1 in n else -2.0
    return calibrated(m, all_.where("calibrates"))


class Scorer:
    def __init__(self, m: Model):
        self.m = m

    def many(self, texts: Iterable[str | None]) -> np.ndarray:
        scores = [self.m.score(self.m.top(self.m.peaks(rows, bounds)[0])) for rows, bounds in rows_of_texts(texts)]
        return np.concatenate(scores).astype(np.float64) if scores else np.empty(0)

    def __call__(self, text: str | None) -> float:
        return float(self.many([text])[0])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` of each row; texts are scored whole.

    Null and empty texts are one empty word; repeated rows score alike; an empty
    table gives an empty result; unknown and null languages are cut at 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        scorer = Scorer(m)
        for b in batches:
            s = scorer.many(texts_of(b))
            limit = np.array([m.thresholds.get(g, 0.5) for g in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)],
                ["doc_id", "held_out", "score", "predicted", "flagged"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(F.col("doc_id")) == 0).alias("held_out"), "text", "lang")
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, flagged boolean")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
