import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, row long, size long"


def table(spark, rows):
    """documents with extra columns whose names clash with the operators' own; rows: (doc_id, text[, source[, lang]])."""
    full = []
    for r in rows:
        doc_id, text, source, lang = (*r, *("s0", "en")[len(r) - 2 :]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None, 7, True, 3, 9))
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: table(spark, rows)


#: Null, empty, blank, short, repeated, non-ASCII and very long texts.
AWKWARD = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one"),
    (4, "a b c d"),
    (4, "a b c d"),
    (5, "A  b\nC d"),
    (6, "x " * 30000),
    (7, "w" * 20000),
    (8, "été 日本語 🙂 naïve <|endoftext|> it's 12.5% 　wide"),
    (None, "no id at all here"),
]


@pytest.fixture(scope="session")
def awkward():
    return AWKWARD


@pytest.fixture(scope="session")
def corpus():
    """Random prose with copies, near copies and junk."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 8))) for _ in range(400)]
    rows, base = [], []
    for i in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randrange(20, 200))]
        base.append(words)
        rows.append((i, " ".join(words), f"s{i % 3}"))
    for i in range(120, 200):
        words = list(base[r.randrange(20)])
        for _ in range(r.choice([0, 0, 1, 2, 6, 12])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, r.choice([" ", "\n", "  "]).join(words), f"s{i % 3}"))
    return rows
