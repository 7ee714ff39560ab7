import hashlib
import re

from strandgraph.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        flat = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(flat, []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for flat, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(m[2], keep, len(members), m[2] == keep, hashlib.sha256(flat.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def check(docs, rows, support):
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, support).collect()), key=repr) == brute(rows)


def test_awkward(docs_of, awkward):
    check(docs_of(awkward), awkward, 1 / 1000)


def test_heavy_and_light_groups(docs_of, corpus):
    rows = corpus + [(1000 + i, f"hot{' ' * (i % 5)}text") for i in range(150)]
    for support in (0.5, 0.1, 1 / 1000):
        check(docs_of(rows), rows, support)


def test_frequent_digests_are_found_and_bounded(docs_of, corpus):
    rows = corpus + [(1000 + i, "hot") for i in range(150)]
    found = exact_dedup.frequent_digests(exact_dedup.digests(docs_of(rows)).repartition(3), 0.1).collect()
    assert len(found) <= 10 and hashlib.sha256(b"hot").digest() in {bytes(r["digest"]) for r in found}


def test_empty(docs_of):
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
