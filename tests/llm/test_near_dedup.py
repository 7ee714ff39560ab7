import numpy as np

from strandgraph.llm import near_dedup, shingles


def sets_of(rows):
    out = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        if doc_id is not None:
            out[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows, percent=75):
    s = sets_of(rows)
    label = {d: d for d in s}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {d: (len(s[d]), top(d)) for d in s}


def check(docs, rows, **options):
    expected = brute(rows)
    got = near_dedup.near_dedup(docs, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward(docs_of, awkward):
    check(docs_of(awkward), awkward)


def test_corpus(docs_of, corpus):
    check(docs_of(corpus), corpus)


def test_branching_and_crowds(docs_of, corpus):
    check(docs_of(corpus), corpus, small=2, levels=2)


def test_crowds_in_blocks(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup.crowd_links, "__defaults__", (3,))
    check(docs_of(corpus), corpus, small=0, levels=1)


def test_empty(docs_of):
    assert near_dedup.near_dedup(docs_of([])).count() == 0


def test_components_are_minima(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 60), (60, 55)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 10 for i in range(10, 41)}, 50: 50, 55: 50, 60: 50}


def test_block_links():
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 2**63, 80).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[r.random(80) < 0.93], r.integers(0, 2**63, 4).astype(np.uint64)])) for _ in range(12)]
    sets += [np.sort(r.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(4)]

    def parts(edges, n):
        p = list(range(n))
        for a, b in edges:
            x, y = p[a], p[b]
            p = [x if v == y else v for v in p]
        return {tuple(i for i in range(n) if p[i] == v) for v in p}

    pairs = [(i, j) for i in range(16) for j in range(i) if shingles.linked(sets[i], sets[j])]
    assert parts(near_dedup.block_links(sets, None, 75, columns=7), 16) == parts(pairs, 16)
    across = [(i, j) for i in range(8) for j in range(8, 16) if shingles.linked(sets[i], sets[j])]
    assert parts(near_dedup.block_links(sets[:8], sets[8:], 75, columns=7), 16) == parts(across, 16)


def test_tree_count_reaches_recall():
    for levels in (1, 3):
        t = near_dedup.tree_count(0.999, 75, 2, levels)
        assert (1 - (1 - 0.25**2) ** levels) ** t <= 0.001


def test_every_link_of_the_test_table(spark):
    """Recall on real-looking documents: components equal those of all linked pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    labels = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    assert got == labels and sum(c != d for d, (_, c) in got.items()) > 20
