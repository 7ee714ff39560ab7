import random
from collections import Counter, defaultdict

import numpy as np

from strandgraph.llm import line_dedup

LINE = "this notice was printed on page {} of the weekly report for readers"


def test_recurring_templates_go(docs_of):
    rows = [
        (5, "a story of its own with words\n" + LINE.format(12)),
        (6, LINE.format(7) + "\nanother story that has other words"),
        (7, "a third story also has its words\n" + LINE.format("12") + "\nshort line"),
        (8, "short line\nx y z"),
        (9, "twice within one document only yes\ntwice within one document only yes"),
    ]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["dropped"]) for r in line_dedup.line_verdicts(docs_of(rows)).collect()}
    assert got == {5: (2, 0, ""), 6: (2, 1, "0"), 7: (3, 1, "1"), 8: (2, 0, ""), 9: (2, 0, "")}
    cleaned = line_dedup.line_dedup(docs_of(rows))
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert cleaned.columns == docs_of(rows).columns
    assert texts[6] == "another story that has other words" and texts[7] == "a third story also has its words\nshort line" and texts[9] == rows[4][1]


def test_parse_generalises():
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "a b c q r s t u"), (4, "a b c d e z y x"), (5, "a b c d e f")]
    coded = [(k, np.array([ord(c) for c in line.split()], np.uint16)) for k, line in rows]
    assert line_dedup.parse(coded) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_lines_of_texts():
    texts = [b"one two three four five\n\n six 7 eight nine ten\n", b"", b"\n", b"one two three four five\none two three four 5a five"]
    x = line_dedup.Lines(texts)
    assert list(zip(x.text.tolist(), x.no.tolist(), x.n.tolist(), strict=True)) == [(0, 0, 5), (0, 2, 5), (3, 0, 5), (3, 1, 6)]
    assert x.hash[0] == x.hash[2] != x.hash[1] and x.leaf[0] == x.leaf[2] != x.leaf[3]
    y = line_dedup.Lines([b"six 99 eight nine ten", b"Six 7 eight nine ten"])
    assert y.hash[0] == x.hash[1] != y.hash[1]
    assert np.frombuffer(x.token_bytes(1), np.uint16)[1] == 0
    assert len(line_dedup.Lines([b"", b" "]).n) == 0


def brute(rows, least=1):
    """Verdicts by a plain tree: (doc_id, n_lines, dropped)."""
    found, copies, order = [], Counter(), {}
    for d, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            words = line.encode().split()
            if not words:
                continue
            tokens = tuple(None if any(48 <= c <= 57 for c in w) else w for w in words)
            if len(words) < 5 and not any(tokens):
                tokens = tuple(words)
            found.append((d, no, tokens))
            copies[tokens] += 1
            order[tokens] = int(line_dedup.Lines([line.encode()]).hash.view(np.int64)[0])
    leaves = defaultdict(list)
    for tokens in sorted(copies, key=lambda x: (-copies[x], order[x])):
        leaves[len(tokens), tokens[:3] if len(tokens) >= 5 else tokens].append(tokens)
    template = {}
    for lines in leaves.values():
        held = []  # [first line, tokens with variable places]
        for tokens in lines:
            for one in held:
                if sum(a == b for a, b in zip(one[1], tokens, strict=True)) >= 0.75 * len(tokens):
                    one[1] = [a if a == b else None for a, b in zip(one[1], tokens, strict=True)]
                    break
            else:
                one = [tokens, list(tokens)]
                held.append(one)
            template[tokens] = one[0]
    places = defaultdict(list)
    for d, no, tokens in found:
        places[template[tokens]].append((d, no))
    gone = {p for x in places.values() if len({d for d, _ in x}) > 1 for p in x if p != min(x)}
    return sorted((d, sum(x[0] == d for x in found), ",".join(str(no) for no in sorted(no for e, no in gone if e == d))) for d, _ in rows)


def test_like_a_plain_tree(spark, docs_of, tmp_path):
    r = random.Random(5)
    words = ["a", "b", "c", "d", "7", "x1", "E"]
    lines = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 5, 6, 8, 9]))) for _ in range(150)] + [LINE.format(x) for x in (1, "two", 3)] + ["", " "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(8)))) for i in range(150)] + [(900, None)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["n_lines"], x["dropped"]) for x in got) == brute(rows) and sum(x["n_dropped"] for x in got) > 100


def test_split_leaves_still_find_copies(docs_of):
    rows = [(i, f"same first three words w{'abcdefghij'[i % 10]} then more of the same {i // 10}") for i in range(60)]
    got = line_dedup.line_verdicts(docs_of(rows), leaf_size=2).collect()
    assert sum(r["n_dropped"] for r in got) >= 50


def test_large_leaves_give_what_small_ones_give(docs_of):
    rows = [(i, f"same first three words w{'abcdefghij'[i % 10]} then more of the same {i // 10}") for i in range(60)]
    rows += [(100 + i, f"the same start {'abcdefghijklmnopqrstuvwxyz'[i]} {'zyxwvutsrqponmlkjihgfedcba'[i]} and an end that all of them have here") for i in range(26)]
    verdicts = lambda **options: sorted(map(tuple, line_dedup.line_verdicts(docs_of(rows), **options).collect()))
    got = verdicts(leaf_size=2)
    assert got == verdicts(leaf_size=10**9) and sum(r[2] for r in got) == 59 + 25


def test_index_equals_comparison_with_all():
    r = np.random.default_rng(3)
    for n in (5, 6, 8, 13, 30):
        for values in (3, 12):
            coded = [(k, np.concatenate([[7, 7, 7], r.integers(0, values, n - 3)]).astype(np.uint16)) for k in range(400)]
            assert line_dedup.parse(coded, leaf_size=1) == line_dedup.parse(coded, leaf_size=10**9)


def test_short_lines_go_in_the_query(spark, docs_of, tmp_path):
    rows = [
        (1, "All rights reserved.\na story with words of its own here\n12"),
        (2, "And\nAll rights  reserved.\n12\nPage 3 of 9"),
        (3, "all rights reserved.\n13\nPage 4 of 9\nAnd then he went"),
        (4, "And\nAnd then he said\nAll rights reserved.\nonce\nonce"),
        (5, "7 8\n7 8"),
    ]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, ""), 2: (4, "1,2"), 3: (4, "2"), 4: (5, "0,2"), 5: (2, "")}


def test_awkward(docs_of, awkward):
    got = line_dedup.line_verdicts(docs_of(awkward)).collect()
    assert len(got) == len(awkward) and {r["n_lines"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert line_dedup.line_verdicts(docs_of([])).count() == 0
