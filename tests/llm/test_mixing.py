import pytest

from strandgraph.llm import mixing


def level(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by repeated resharing."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[k] for k in open_)
        over = [k for k in open_ if left * w[k] / total > most * sizes[k]]
        if not over:
            return out | {k: left * w[k] / total for k in open_}
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        open_ -= set(over)
    return out


def check(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, *s in rows:
        sizes[s[0] if s else "s0"] = sizes.get(s[0] if s else "s0", 0) + len((t or "").encode().split())
    targets = level(sizes)
    source = {r[0]: (r[2] if len(r) > 2 else "s0") for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    longest = {s: max([len((t or "").encode().split()) for d, t, *_ in rows if source[d] == s]) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1
    return got


def test_corpus(docs_of, corpus):
    rows = corpus + [(5000 + i, "p q r s", None) for i in range(40)] + [(6000, None, "z"), (6001, "", "z")]
    first = check(docs_of(rows), rows)
    assert sorted(first) == sorted(mixing.mix(docs_of(rows).repartition(3)).collect())


def test_few_bins_give_the_same(docs_of, corpus):
    full = sorted(mixing.mix(docs_of(corpus)).collect())
    assert sorted(mixing.mix(docs_of(corpus), bins=2).collect()) == full


def test_longer_documents_are_likelier(docs_of):
    rows = [(i, "w " * (40 if i % 2 else 10), "a") for i in range(2000)] + [(9000 + i, "w " * 25, "b") for i in range(2000)]
    got = mixing.mix(docs_of(rows)).where("doc_id < 9000 AND source_size > 0").collect()
    rate = lambda odd: sum(r["taken"] > r["size"] for r in got if r["doc_id"] % 2 == odd)
    part = [r for r in got if r["target"] / r["source_size"] % 1]
    if part:
        assert rate(1) >= rate(0)


def test_awkward(docs_of, awkward):
    got = mixing.mix(docs_of(awkward)).collect()
    assert len(got) == len(awkward) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs_of([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs_of([(1, None), (2, " ")])).collect()] == [0, 0]


def test_kept_columns(docs_of, corpus):
    got = mixing.mix(docs_of(corpus), keep=True)
    r = got.where("doc_id = 3").first()
    assert r["row"]["size"] == 9 and r["taken"] == r["n_copies"] * r["size"]
