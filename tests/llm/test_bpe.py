import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandgraph.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(awkward, corpus):
    r = random.Random(1)
    bits = ["a", "th", "e", " ", "  ", "\n", "'s", "'", "1", "23", "é", "!", "<|endoftext|>", " ", "🙂", "　", "Zx", "\t", "\x1c", "՘", "한"]
    odd = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    return [t for _, t, *_ in awkward + corpus[:40]] + odd + ["ab" * 3000, " " * 3000, "a<|endoftext|>"]


def test_like_the_library(library, texts):
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        spelled, decoded = bpe.round_trip(t, PATH)
        assert spelled[1:] == ",".join(map(str, ids))
        assert decoded.decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
        assert bpe.load(PATH).encode(t or "") == ids and bpe.load(PATH).decode(ids) == (t or "")
        assert token_counts.count_tokens(t, PATH) == len(ids)
        assert token_counts.count_tokens(t, PATH, chunk=11) == len(ids)


def test_memos_may_be_small(texts):
    b = bpe.load(PATH)
    small, large = bpe.Coder(b, 3000), bpe.Coder(b)
    counts = token_counts.Counts(token_counts.Transducer(b, 5), 3000)
    for t in texts[11:40]:
        for unit in b.units((t or "").replace("<|endoftext|>", "")):
            assert small.units[unit] == large.units[unit] and small.decode(small.units[unit]) == unit.encode()
            assert counts[unit] == small.units[unit].count(",")
    assert 0 < small.units.size <= 1500 and len(small.units) < 20


def test_long_entries_are_not_held():
    c = bpe.Coder(bpe.load(PATH))
    assert c.units["w" * 5000] == c.units["w" * 5000]
    assert not c.units and not c.pieces


def test_work_of_new_words():
    r = random.Random(5)
    words = ["".join(r.choice(["er", "th", "in", "keit", "ó", "tion", "an"]) for _ in range(r.randrange(2, 6))) for _ in range(3000)]
    bpe.coder.cache_clear()
    bpe.round_trip("warm", PATH)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        bpe.round_trip(" ".join(words), PATH)
    finally:
        sys.setprofile(None)
    distinct = len(set(words))
    assert distinct > 1500 and calls < 50 * distinct
    bpe.coder.cache_clear()
    bpe.round_trip("été house house, house. house's", PATH)
    assert set(bpe.coder(PATH).units) == {"été", " house", ",", ".", "'s"}  # nothing is held once for each mark after it


def test_plain_characters_are_cut_like_the_library(library):
    b, r = bpe.load(PATH), random.Random(3)
    every = [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    assert not bpe.OTHER.search("".join(every)) and all(bpe.OTHER.search(chr(i)) for i in (0x250, 0x200F, 0x2028, 0x202F, 0x205F, 0x3000, 0x1F642))
    for x in every:
        for t in (x, f"a{x}b", f" {x}1", f"1{x}{x} ", f"!{x}a", f"\t{x}\n a", f"'{x}s", f"  {x}'t"):
            cut = bpe.PLAIN.findall(t)
            assert "".join(cut) == t and cut == b.pretoken.findall(t)
            assert cut == [t[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(t)]
            assert not bpe.WORD.fullmatch(t) or cut == [t]
    for _ in range(300):
        t = "".join(r.choice(every) for _ in range(60))
        assert b.pretokens(t) == b.pretoken.findall(t)
        assert bpe.round_trip(t, PATH)[0][1:] == ",".join(map(str, library.encode(t, add_special_tokens=False).ids))


def test_pretokens_as_long_as_places_of_the_queue(library):
    b, r = bpe.load(PATH), random.Random(4)
    for n in (len(bpe.PLACES) - 1, len(bpe.PLACES), len(bpe.PLACES) + 1, 3 * len(bpe.PLACES)):
        for letters in ("a", "etaoin", "abcdefghijklmnopqrstuvwxyzé"):
            t = "".join(r.choice(letters) for _ in range(n - (letters == "a")))
            assert b.merge(t.encode()) == library.encode(t, add_special_tokens=False).ids


def test_scan_is_associative(texts):
    counts = token_counts.compiled(PATH)
    text = "".join(t.replace(" ", "") for t in texts[11:20]).replace("<|endoftext|>", "") + "qxz" * 100 + " tail"
    for warm in (512, 0):  # without warm-up no guess but the start state is right
        token_counts.WARM, held = warm, token_counts.WARM
        try:
            fresh = lambda: list(token_counts.maps_of(text, counts, 9))
            maps = fresh()
            whole = token_counts.prefix_scan(fresh(), counts.machine)[-1]
            left = maps[0]
            for m in maps[1:]:
                left = left.then(m, counts.machine)
            right = maps[-1]
            for m in maps[-2::-1]:
                right = m.then(right, counts.machine)
        finally:
            token_counts.WARM = held
        assert len(maps) > 20
        expected = (token_counts.START, len(bpe.load(PATH).encode(text)))
        assert whole.to[token_counts.START] == left.to[token_counts.START] == right.to[token_counts.START] == expected


def test_a_pretoken_of_millions_of_bytes(library):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(2_000_000))
    assert token_counts.count_tokens(text, PATH) == len(library.encode(text, add_special_tokens=False).ids)


def test_queries(docs_of, awkward, library):
    docs = docs_of(awkward)
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(docs).collect()}
    for doc_id, t, *_ in awkward:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (doc_id, len(ids), sha(",".join(map(str, ids))), sha(t or "")) in rows
    counts = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, limit=5, chunk=100).collect()}
    assert counts == {(d, len((t or "").encode()), n, n > 5) for d, t, *_ in awkward for n in [len(library.encode(t or "", add_special_tokens=False).ids)]}
    full = {r["doc_id"]: r for r in bpe.encode_documents(docs).collect()}
    assert full[4]["decoded"] == "a b c d" and full[1]["ids"] == [] and full[0]["decoded"] == ""
    assert bpe.digest_documents(docs_of([])).count() == token_counts.token_counts(docs_of([])).count() == 0
