import re
from collections import Counter

from strandgraph.llm import quality


def counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts(docs_of, awkward, corpus):
    rows = awkward + corpus + [(900 + i, x) for i, x in enumerate(["a a a a", "a a a a a", "a b a b a", "a b c a b", "b a a a", "a a a", "a b c d a b c", "a a a a a a", "#a $b\n#a $b\n\n x", "p q r s p q r t p q r"])]
    got = sorted(quality.quality_rules(docs_of(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), key=repr)
    expected = []
    for doc_id, text, *_ in rows:
        c = counts(text)
        expected.append((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_hosts(docs_of):
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, good(i), f"h{i % 5}") for i in range(100)]
    rows += [(200 + i, "too short", "bad") for i in range(300)] + [(600, good(600), "bad")]
    rows += [(700, "short", "tiny"), (701, good(701), None), (702, good(702).replace("w", "#$%"), "h1")]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(rows)).collect()}
    rates = {r["doc_id"]: r["host_rate"] for r in quality.quality_rules(docs_of(rows)).collect()}
    assert all(kept[i] for i in range(100)) and kept[701]
    assert not kept[600] and not kept[702] and not kept[700]
    assert rates[700] < 1 and rates[700] < rates[200]  # one document is shrunk more than three hundred
    whole = quality.kept_rows(docs_of(rows))
    assert whole.columns == docs_of(rows).columns and sorted(r["doc_id"] for r in whole.collect()) == sorted(i for i, k in kept.items() if k)


def test_suspect_hosts_are_held_to_strict_limits(docs_of):
    """A planted host whose lines repeat far more often than on other hosts: its borderline documents fall, clean ones and those elsewhere stay."""
    words = lambda i, n=60: " ".join(f"w{i}x{k}" for k in range(n))
    lines = lambda i, repeated: "\n".join([words(f"{i}a{k}", 20) for k in range(10 - repeated)] + [words(f"{i}a0", 20)] * repeated)
    rows = [(1000 * h + i, lines(f"{h}d{i}", 2) if i < 5 else words(f"{h}d{i}"), f"h{h}") for h in range(20) for i in range(40)]
    rows += [(90000 + i, lines(f"b{i}", 4), "bad") for i in range(30)] + [(91000 + i, lines(f"c{i}", 2), "bad") for i in range(5)] + [(92000 + i, words(f"e{i}"), "bad") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(rows)).collect()}
    assert {r["host_suspect"] for i, r in got.items() if i >= 90000} == {"lines"} and {r["host_suspect"] for i, r in got.items() if i < 90000} == {""}
    assert not any(got[i]["kept"] for i in got if 90000 <= i < 92000)
    assert all(got[i]["kept"] for i in got if i < 90000 or i >= 92000)
    assert got[91000]["n_dup_lines"] == got[0]["n_dup_lines"] == 2


def test_one_host_and_none(docs_of):
    assert quality.quality_rules(docs_of([])).count() == 0
    r = quality.quality_rules(docs_of([(1, "short")])).first()
    assert r["host_rate"] == round(2 / 3, 6) and not r["kept"]
