import hashlib
import random
import re

from strandgraph.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def joined(s):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in s)


def test_base_patterns(docs_of, awkward):
    r = random.Random(2)
    bits = ["a@b.co", "_m@x.y", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-1234", "9", "0", ".", " ", "@", "-", "x", "é", "🙂", "+", "001.002.3.4", "300.1.1.1", "call ", "\n", "%", "("]
    rows = awkward + [(1000 + i, "".join(r.choice(bits) for _ in range(r.randrange(30)))) for i in range(400)] + [(2000, "1" * 5000), (2001, "a@" * 3000)]
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.personal_data(docs_of(rows)).collect()), key=repr)
    expected = []
    for d, t, *_ in rows:
        s = spans(t)
        expected.append((d, *(sum(k == x[0] for x in s) for k in PLAIN), hashlib.sha256(joined(s).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_patterns_discover(docs_of):
    rows = [(i, f"words here and contact: user{i}@mail.org more") for i in range(20)]
    rows += [(100, "please contact: user77[at]mail today"), (101, "the 2020 contact lens"), (102, "room 2020 is here")]
    rows += [(200 + i, f"the user{i}@mail.org") for i in range(4)] + [(300 + i, "the cat and the dog") for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(rows)).collect()}
    assert got[100] == "email:16:30" and got[101] == got[102] == ""
    assert got[0] == joined(spans(rows[0][1]))


def test_words_without_digits_and_new_patterns(docs_of):
    rows = [(i, f"words here and contact: user{i}@mail.org more") for i in range(40)]
    rows += [(100, "please contact:  jane.doe[at]mail\ttoday"), (101, "today words please"), (102, "contact: 77[at]mail 0171 555 0123")]
    rows += [(200 + i, f"contact: id{i}[at]mail or\nping: id{i}[at]mail") for i in range(12)] + [(300, "x 7 ping: zed9[at]mail 🙂 ping: other[at]mail")]
    rows += [(400, "contact: words"), (401, "contact: a@b.co, contact: 5")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(rows)).collect()}
    assert got[100] == "email:17:33" and got[101] == "" and got[102] == "email:9:19"
    assert got[200] == "email:9:20,email:30:41"
    assert got[300] == "email:10:22,email:31:44"
    assert got[400] == "" and got[401] == "email:9:15,email:26:27"


def test_words_after_and_long_texts(docs_of):
    rows = [(i, f"u{i}@mail.org (email) and words") for i in range(30)] + [(100, "see x7[at]mail (email) please")]
    rows += [(200, "word " * 50_000 + "x9[at]mail (email)"), (201, "12 " * 200_000 + "a@b.co"), (202, "w" * 1_000_000 + " a@b.co")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs_of(rows)).collect()}
    assert got[100]["spans"] == "email:4:14" and got[200]["spans"] == "email:250000:260000".replace("260000", "250010")
    assert got[201]["spans"] == "email:600000:600006" and got[202]["spans"] == "email:1000001:1000007"
    assert got[5]["spans"] == joined(spans(rows[5][1]))


def test_empty(docs_of):
    assert pii.personal_data(docs_of([])).count() == 0
