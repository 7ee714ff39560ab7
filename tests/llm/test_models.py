import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandgraph.llm import lm_score, toxicity


def brute_base(rows):
    n = Counter()
    for d, t, *_ in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            n.update([*(t or "").encode().lower().split(), None])
    total, v = sum(n.values()), len(n)
    out = []
    for d, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, len(w), sum(n[x] > 0 for x in w), total, sum(math.log10((n[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [5, 400_000])
def test_base_scores(docs_of, awkward, corpus, most):
    rows = awkward + corpus
    got = lm_score.lm_score(docs_of(rows), rounds=1, most=most).collect()
    base = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    for a, b in zip(base, brute_base(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_no_training_texts(docs_of):
    rows = [(d, "some words") for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1]
    got = lm_score.lm_score(docs_of(rows)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in got)
    assert lm_score.lm_score(docs_of([])).count() == 0


def test_gradients():
    m = {k: v.astype(np.float64) for k, v in lm_score.fresh().items()}
    r = np.random.default_rng(0)
    inputs, targets, place = lm_score.windows(r.integers(0, lm_score.CLASSES, 100), np.array([0, 3, 60, 100]))
    g = lm_score.gradients(m, inputs, targets, place >= 0)
    loss = lambda: -(lm_score.log_class(m, inputs, targets)[place >= 0] * math.log(10)).mean()
    for k in m:
        at = (int(inputs[-1, -1]), 3) if k == "embed" else tuple(r.integers(0, n) for n in m[k].shape)
        held = m[k][at]
        m[k][at] = held + 1e-4
        up = loss()
        m[k][at] = held - 1e-4
        down = loss()
        m[k][at] = held
        assert (up - down) / 2e-4 == pytest.approx(float(g[k][at]), abs=2e-6)


def slow_log_class(m, context, target):
    """log10 probability of ``target`` after the classes ``context``, in plain Python: the last one asks, all of them answer."""
    w, dot = lm_score.WIDTH, lambda x, y: sum(float(a) * float(b) for a, b in zip(x, y, strict=True))
    rows = lambda x, name: [dot(x, m[name][:, j]) for j in range(m[name].shape[1])]
    embeds = [m["embed"][c] for c in context]
    q = rows(embeds[-1], "q")
    weights = [math.exp(dot(q, rows(x, "k")) / math.sqrt(w) + float(m["near"][len(context) - 1 - i])) for i, x in enumerate(embeds)]
    values = [rows(x, "v") for x in embeds]
    y = [float(embeds[-1][j]) + sum(a * v[j] for a, v in zip(weights, values, strict=True)) / sum(weights) for j in range(w)]
    r = [max(a + float(b), 0) for a, b in zip(rows(y, "up"), m["up_b"], strict=True)]
    z = [a + b for a, b in zip(y, rows(r, "down"), strict=True)]
    logits = [a + float(b) for a, b in zip(rows(z, "out"), m["out_b"], strict=True)]
    return (logits[target] - math.log(sum(map(math.exp, logits)))) / math.log(10)


def test_windows_score_like_a_slow_model():
    """Each place once, with the contexts that the windows define, none across texts."""
    classes, bounds = np.random.default_rng(1).integers(0, lm_score.CLASSES, 80), np.array([0, 1, 20, 80])
    inputs, targets, place = lm_score.windows(classes, bounds)
    assert sorted(place[place >= 0].tolist()) == list(range(80))
    m = {k: v * 2 for k, v in lm_score.fresh().items()}
    got = np.zeros(80)
    got[place[place >= 0]] = lm_score.log_class(m, inputs, targets)[place >= 0]
    for first, last in ((0, 1), (1, 20), (20, 80)):
        for i in range(first, last):
            begin = first + (i - first) // lm_score.STRIDE * lm_score.STRIDE - (lm_score.CONTEXT - lm_score.STRIDE)
            context = [0] * (begin - 1 < first) + classes[max(begin - 1, first) : i].tolist()
            assert got[i] == pytest.approx(slow_log_class(m, context, int(classes[i])), abs=1e-4)


def test_probabilities_sum_to_one():
    """Of all words in a class, and of all pieces in a class after the same bytes."""
    keys, n, suffix = np.arange(10, 400), np.arange(390) + 1, (np.arange(390) % lm_score.SUFFIX).astype(np.int8)
    v = lm_score.Vocabulary.of(np.append(keys, lm_score.END), np.append(n, 7), np.append(suffix, np.int8(0)), 7)
    p = np.bincount(v.class_of[v.class_of >= 0], weights=10 ** v.log_p[v.class_of >= 0], minlength=lm_score.CLASSES)
    assert np.allclose(p[1 : lm_score.SINGLE + lm_score.SUFFIX], 1) and v.mass.sum() == pytest.approx(n.sum() - 0.75 * len(n) + 7)
    cells = 10.0 ** lm_score.cell_logs(np.random.default_rng(0).integers(0, 3, lm_score.CELLS).astype(float))
    assert np.allclose(cells[: lm_score.FIRST].reshape(-1, 64).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(cells[lm_score.FIRST :].reshape(-1, 257).sum(axis=1), 1, atol=1e-4)


def test_subwords():
    texts = ["The cat the éa", "", "x the"]
    count_of = lambda w: lm_score.word_hashes(*lm_score.spans([w.encode()])[:3])[0]
    v = lm_score.Vocabulary.of(np.array([count_of("the"), lm_score.END]), np.array([4, 3]), np.zeros(2, np.int8), 3)
    x, _ = lm_score.Subwords.both([t.encode() for t in texts], v, np.zeros(3, np.uint64))
    begin, inner = lm_score.SINGLE + lm_score.SUFFIX + 4, lm_score.SINGLE + lm_score.SUFFIX
    assert x.classes.tolist() == [1, begin + 1, inner + 1, 1, begin + 3, inner + 1, 0, 0, begin + 1, 1, 0]  # c|a t: two pieces; é is two bytes, then a
    assert x.bounds.tolist() == [0, 7, 8, 11] and x.n_words.tolist() == [4, 0, 2] and x.n_held.tolist() == [2, 0, 1]
    assert len(x.pieces) == 5 and len(x.tail) == 3 and x.tail_bounds.tolist() == [0, 2, 2, 3]


def test_model_learns(docs_of):
    rows = [(i, " ".join(["alpha", "beta", "gamma", "delta"] * 40)) for i in range(600)] + [(1000 + i, "zeta eta theta iota kappa " * 20) for i in range(5)]
    docs = docs_of(rows).coalesce(1)
    trained = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.lm_score(docs).collect()}
    raw = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.lm_score(docs, rounds=0).collect()}
    base = {r["doc_id"]: r["base_score"] / r["n_tokens"] for r in lm_score.lm_score(docs, rounds=0).collect()}
    assert trained[0] > raw[0] + 0.1 and trained[0] > trained[1000] and trained[0] > base[0]


def test_partitions_do_not_change_scores(docs_of, corpus, awkward):
    rows = corpus + awkward
    one, many = ({(r["doc_id"], r["n_tokens"]): r for r in lm_score.lm_score(docs_of(rows).repartition(n), shard=4000).collect()} for n in (1, 64))
    assert one.keys() == many.keys() and len(one) > 200
    for k in one:
        assert one[k]["score"] == pytest.approx(many[k]["score"], rel=1e-6) and one[k]["base_score"] == pytest.approx(many[k]["base_score"], rel=1e-9)


def test_every_window_is_fitted_on(spark, monkeypatch):
    """All passes and shards together see each window of each text once."""
    lengths = [1, 5, 24, 25, 100, 1000, 3 * lm_score.CHUNK + 7]
    train = spark.createDataFrame([(i, bytearray([i + 1]) * n) for i, n in enumerate(lengths)], "key long, classes binary")
    plain, seen = type(train).toArrow, []

    def watched(self):
        t = plain(self)
        if t.column_names == ["i", "x"] and len(t):
            seen.append(int(t.sort_by("i")["x"].to_numpy()[-1]))  # the last number of a pass's sums: its windows
        return t

    monkeypatch.setattr(type(train), "toArrow", watched)
    chunks = [min(lm_score.CHUNK, n - i) for n in lengths for i in range(0, n, lm_score.CHUNK)]
    for rounds, shard in ((1, 10**9), (2, 20_000), (3, 10**9)):
        seen.clear()
        lm_score.fit(train, np.ones(lm_score.CLASSES), rounds, shard)
        assert sum(seen) == sum(-(-n // lm_score.STRIDE) for n in chunks)


def test_counts_of_cells_come_in_blocks(spark, monkeypatch):
    """Neither tasks nor the driver handle a row for each cell: at scale each task has most of them."""
    r = np.random.default_rng(8)
    cells = [np.stack([r.integers(0, lm_score.FIRST, n), r.integers(lm_score.FIRST, lm_score.CELLS, n)], axis=1).astype(np.int32) for n in (0, 1, 40, 30_000, 50_000)]
    train = spark.createDataFrame([(bytearray(c.tobytes()),) for c in [*cells, cells[2]]] + [(None,)], "pieces binary").repartition(3)
    plain, rows = type(train).toArrow, []

    def watched(self):
        t = plain(self)
        rows.append(len(t))
        return t

    monkeypatch.setattr(type(train), "toArrow", watched)
    got = lm_score.cell_counts(train)
    assert np.array_equal(got, np.bincount(np.concatenate([*cells, cells[2]]).ravel(), minlength=lm_score.CELLS))
    assert (got > 0).sum() > 100_000 and sum(rows) <= -(-lm_score.CELLS // 4096)
    assert not lm_score.cell_counts(train.limit(0)).any()


def test_words_are_counted_a_bounded_number_at_a_time(docs_of, awkward, corpus, monkeypatch):
    """A task that holds few words gives more rows, but the same counts."""
    docs, plain, held = docs_of(awkward + corpus).coalesce(1), lm_score._counted, []
    of = lambda: sorted(map(tuple, lm_score.count(docs).collect()))
    whole = of()
    monkeypatch.setattr(lm_score, "WORDS", 100)
    monkeypatch.setattr(lm_score.sh, "GROUP", 2000)
    assert of() == whole
    # in this process, as a task does it
    monkeypatch.setattr(lm_score, "_counted", lambda keys: held.append(len(keys)) or plain(keys))
    texts = pa.RecordBatch.from_arrays([pa.array([t for _, t, *_ in corpus])], ["text"])

    class Docs:
        def __getattr__(self, name):
            return lambda *a: [b for b in a[0](iter([texts]))] and self if name == "mapInArrow" else self

    monkeypatch.setattr(lm_score, "_read", lambda _: Docs())
    lm_score.count(None)
    assert len(held) > 10 and max(held) < 100 + 2000


def test_largest_numbers_are_taken_off_only_if_needed():
    """Rows whose exponentials overflow or vanish have the same shares as rows whose don't; others are left as they are."""
    r = np.random.default_rng(9)
    x = r.normal(0, 3, (50, 20)).astype(np.float32)
    own = r.integers(0, 20, 50)
    exact = np.exp(x.astype(float)) / np.exp(x.astype(float)).sum(axis=1, keepdims=True)
    times = []
    for shift in (0, 60, 200, -200, np.where(np.arange(50) == 7, -500, 0)[:, None]):
        made = []
        e, sums, held = lm_score._exps(lambda: made.append(1) or (x + shift).astype(np.float32), own)  # noqa: B023
        times.append(len(made))
        assert np.allclose(e / sums[:, None], exact, rtol=1e-3) and np.allclose(held - np.log(sums), np.log(exact[np.arange(50), own]), atol=1e-3)
    assert times == [1, 1, 1, 2, 2]
    # after fitting the longest row times the longest column is over the limit, but no number is: they stay as they are
    m = lm_score.fresh()
    inputs, targets, _ = lm_score.windows(r.integers(0, lm_score.CLASSES, 100), np.array([0, 3, 60, 100]))
    m["out"] *= 60 / (lm_score.forward(m, inputs)["z"] @ m["out"]).max()
    f = lm_score.forward(m, inputs)
    assert np.linalg.norm(f["z"], axis=1).max() * np.linalg.norm(m["out"], axis=0).max() > lm_score.MOST
    odds = f["z"] @ m["out"] + m["out_b"]
    _, sums, held = lm_score.class_odds(m, f, targets)
    assert np.allclose(held, odds[np.arange(len(odds)), targets.ravel()], atol=1e-4)
    assert np.allclose((held - np.log(sums)) / math.log(10), lm_score.log_class(m, inputs, targets).ravel(), atol=1e-5)


def toxic_rows(n=600):
    r = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = list(r.choice(words, 40))
        bad = i % 4 == 0
        if bad:
            text[int(r.integers(40))] = str(r.choice(["vile", "nasty", "rotten"]))
        rows.append((i, " ".join(text), "s0", ["en", "de"][i % 3 == 0]))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, docs_of, awkward):
    rows, labels = toxic_rows()
    docs = docs_of(rows)
    told = spark.createDataFrame([*labels, (None, 1, 1), (10**6, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, told)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(r["predicted"] == y for r, y in held) >= 0.95 * len(held)
    odd = toxicity.toxicity(docs_of(awkward), model).collect()
    assert len(odd) == len(awkward) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in odd)
    assert toxicity.toxicity(docs_of([]), model).count() == 0
    # the language changes the flag, never the score
    other = toxicity.toxicity(docs_of([(i, t, s, "xx") for i, t, s, _ in rows]), model).collect()
    assert {r["doc_id"]: r["score"] for r in other} == {i: r["score"] for i, r in got.items()}


def test_table_scores_equal_the_model():
    m = toxicity.Model.fresh(1)
    for text in ("", "one", "Some words, and MORE words here"):
        assert toxicity.Scorer(m)(text) == pytest.approx(float(m.score(m.maxima(toxicity.rows_of(text))[0])), abs=1e-5)


def test_fit_without_both_labels(spark, docs_of):
    for y in (0, 1):
        m = toxicity.train(docs_of([(1, "a b"), (2, "c")]), spark.createDataFrame([(1, 1, y), (2, 1, y)], "doc_id long, quality int, toxic int"))
        assert (toxicity.Scorer(m)("anything") >= 0.5) == bool(y)
    empty = toxicity.train(docs_of([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert 0 <= toxicity.Scorer(empty)("anything") < 0.5


def test_labels_of_held_out_rows_are_never_read(spark, docs_of):
    rows, labels = toxic_rows(200)
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    assert turned != labels
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs_of(rows), toxicity.train(docs_of(rows), spark.createDataFrame(x, schema))).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]
    m = toxicity.train(docs_of(rows), spark.createDataFrame(labels, schema))
    assert scores[0] == {i: pytest.approx(float(m.score(m.maxima(toxicity.rows_of(t))[0])), abs=1e-5) for i, t, *_ in rows}


def test_bound_on_fitting_texts(spark, docs_of, monkeypatch):
    """Ids go in the order of their hashes, whatever their texts' length, until the bytes are spent."""
    rows, labels = toxic_rows(100)
    rows[7] = (7, "w" * 100_000, "s0", "en")
    seen = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **options: seen.append(sum(len(t) for t in texts)) or plain(texts, y, **options))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for most in (0, 3000, 10_000, 10**9):
        toxicity.train(docs_of(rows), told, most=most)
    assert seen[0] == 0 < seen[1] <= 3000 // 7 < seen[2] < seen[3]


def test_labelled_rows_beyond_the_start_are_fitted_on(spark, docs_of):
    """Each passes through one shard; neither partitions nor the order of rows change the model."""
    rows, labels = toxic_rows(1500)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    seen = []
    for docs in (docs_of(rows).coalesce(1), docs_of(rows[::-1]).repartition(7)):
        model = toxicity.train(docs, told, sample=20, shard=500, rounds=6)
        got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
        assert sum(got[i]["predicted"] == y for i, y in held.items()) >= 0.95 * len(held)
        seen.append(got)
    assert all(seen[0][i]["score"] == pytest.approx(seen[1][i]["score"], abs=1e-3) for i in seen[0])


def test_thresholds_count_every_calibrating_row(spark, docs_of, monkeypatch):
    rows, labels = toxic_rows(300)
    counted = []
    plain = toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda steps, n, hits: counted.append((int(n.sum()), int(hits.sum()))) or plain(steps, n, hits))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxicity.train(docs_of(rows), told, sample=20, rounds=0)
    fitted = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, **options: fitted.append((len(y), int(y.sum()))) or fit(texts, y, **options))
    toxicity.train(docs_of(rows), told)
    learnt = [y for i, _, y in labels if zlib.crc32(str(i).encode()) % 5]
    assert counted[0][0] > 20 and (counted[0][0] + fitted[0][0], counted[0][1] + fitted[0][1]) == (len(learnt), sum(learnt))


def test_best_threshold():
    r = np.random.default_rng(2)
    for _ in range(20):
        steps = r.choice(np.arange(-300, 300), 40, replace=False)
        n = r.integers(1, 5, 40)
        hits = r.integers(0, n + 1)
        odds = np.repeat(steps, n) / toxicity.GRID
        y = np.concatenate([np.arange(k) < h for k, h in zip(n, hits, strict=True)])
        f1 = lambda cut: 2 * (y & (odds >= cut)).sum() / ((odds >= cut).sum() + y.sum())
        assert f1(toxicity.logit(toxicity.best_threshold(steps, n, hits))) == pytest.approx(max(f1(s / toxicity.GRID) for s in steps))


def test_long_texts_score_in_parts_like_whole(monkeypatch):
    text = " ".join(f"wörd{k % 700}_{k}" for k in range(9000))
    m = toxicity.Model.fresh(3)
    rows = toxicity.rows_of(text)
    whole, where, _ = m.maxima(rows)
    monkeypatch.setattr(toxicity, "WORDS", 1000)
    monkeypatch.setattr(toxicity, "GROUP", 5000)
    assert np.array_equal(rows, toxicity.rows_of(text))
    peaks, at = m.peaks(rows, np.array([0, len(rows)]), places=True)
    assert m.top(peaks)[0] == pytest.approx(whole, abs=1e-6) and np.array_equal(at[0], np.concatenate([a for _, a, _ in where]))


def spelled(text, known):
    """Classes and cells of a text, of whose words only ``known`` are in the vocabulary, and natural logarithms of the cells' shares."""
    hash_of = lambda w: lm_score.word_hashes(*lm_score.spans([w.encode()])[:3])[0]
    v = lm_score.Vocabulary.of(np.array([*map(hash_of, known), lm_score.END]), np.full(len(known) + 1, 9), np.zeros(len(known) + 1, np.int8), 9)
    x, _ = lm_score.Subwords.both([text.encode()], v, np.zeros(1, np.uint64))
    return x.classes, x.pieces, lm_score.cell_logs(np.bincount(x.pieces.ravel(), minlength=lm_score.CELLS).astype(float)) * math.log(10)


def test_gradients_of_bytes():
    r = np.random.default_rng(3)
    text = " ".join(r.choice(["the", "of", "Zoë", "x", "wxyz", "日本", "a1b2c3"], 60))
    classes, cells, logs = spelled(text, ["the", "of"])
    m = {k: v.astype(np.float64) for k, v in lm_score.fresh().items()}
    inputs, targets, place = lm_score.windows(classes, np.array([0, len(classes)]), lm_score.piece_inputs(classes, cells))
    pieces = lm_score.Pieces(classes, cells)(targets, place)
    assert len(pieces[0]) == len(cells) > 60
    g = lm_score.gradients(m, inputs, targets, place >= 0, pieces, logs)
    loss = lambda: -(lm_score.log_class(m, inputs, targets, pieces, logs)[place >= 0] * math.log(10)).mean()
    for k, at in (("one", (2, 120)), ("one", (5, 0xE6)), ("two", (3, 256)), ("two", (1, ord("b"))), ("embed", (lm_score.PAD + 1 + ord("z"), 2)), ("v", (3, 4)), ("out", (1, 1)), ("up", (2, 2))):
        held, sides = m[k][at], []
        for h in (1e-5, -1e-5):
            m[k][at] = held + h
            sides.append(loss())
        m[k][at] = held
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(float(g[k][at]), abs=2e-6) and g[k][at] != 0


def test_bytes_follow_the_words_before_them():
    """Counts of bytes within a word give each of two words one half; what stands before tells which it is."""
    classes, cells, logs = spelled("the ax of bx " * 200, ["the", "of"])
    inputs, targets, place = lm_score.windows(classes, np.array([0, len(classes)]), lm_score.piece_inputs(classes, cells))
    pieces = lm_score.Pieces(classes, cells)(targets, place)
    share = lambda m: (lm_score.log_class(m, inputs, targets, pieces, logs) - lm_score.log_class(m, inputs, targets)).ravel()[pieces[0]].mean()
    start = lm_score.fresh(np.bincount(classes, minlength=lm_score.CLASSES))
    assert share(start) == pytest.approx(math.log10(0.5), abs=0.02)
    fitted, seen = lm_score.fit_chunks(start, iter([(classes.tobytes(), cells.tobytes())] * 300), logs)
    assert seen == 300 * len(inputs) and share(fitted) > math.log10(0.9)


def test_chunks_take_their_own_pieces(spark, monkeypatch):
    """A text of several chunks is fitted on with the cells of each chunk's pieces."""
    classes, cells, logs = spelled("the ax of bx zzz " * 30, ["the", "of"])
    assert lm_score._chunked(classes) == []
    monkeypatch.setattr(lm_score, "CHUNK", 100)
    at = lm_score._chunked(classes)
    assert len(at) == -(-len(classes) // 100) - 1 and at[0] == (classes[:100] >= lm_score.SINGLE + lm_score.SUFFIX).sum()
    train = spark.createDataFrame([(1, bytearray(classes.tobytes()), bytearray(cells.tobytes()), at)], "key long, classes binary, pieces binary, at array<int>")
    got = lm_score.fit(train, np.ones(lm_score.CLASSES), 1, 10**9, logs=logs.astype(np.float32))
    order = {classes[100 * i : 100 * i + 100].tobytes(): cells[a:b].tobytes() for i, (a, b) in enumerate(zip([0, *at], [*at, len(cells)], strict=True))}
    # the shard takes chunks in the order of their numbers
    own, _ = lm_score.fit_chunks(lm_score.fresh(np.ones(lm_score.CLASSES)), iter((classes[i : i + 100].tobytes(), order[classes[i : i + 100].tobytes()]) for i in range(0, len(classes), 100)), logs.astype(np.float32))
    assert all(np.allclose(got[k], own[k], atol=1e-5) for k in own)
