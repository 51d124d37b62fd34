"""Secret spans against the patterns as given, links against all pairs."""

import hashlib
import random
import re
import time

import pytest

from terralag.llm import secret_scan

GIVEN = {
    "assign": re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LENGTH = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "hex": lambda m: len(m.group()) >= 24}


def plain_base(text):
    return [(k, *m.span()) for k, p in GIVEN.items() for m in p.finditer(text) if LENGTH[k](m)]


def plain_scan(text, reach):
    """All spans by comparing every pair of candidates."""
    base = plain_base(text)
    weak = []
    for kind in ("account", "phrase", "bare", "endpoint"):
        for m in re.finditer(secret_scan.PATTERNS[kind], text):
            size = len(m.group(2) if kind in ("account", "phrase") else m.group())
            mixed = all(re.search(x, m.group()) for x in ("[A-Z]", "[a-z]", "[0-9]"))
            if size >= secret_scan.LEAST[kind] and (kind != "bare" or mixed):
                weak.append((kind, *m.span()))
    over = lambda x, y: x[1] < y[2] and y[1] < x[2]
    weak = [x for x in weak if not any(over(x, y) for y in base)]
    weak = [x for x in weak if x[0] != "bare" or not any(over(x, y) for y in weak if y[0] != "bare")]
    scopes = [0] * (len(text) + 1)
    for m in re.finditer(secret_scan.BLANK, text):
        for i in range(m.end(), len(text) + 1):
            scopes[i] += 1
    def beside(x, kinds):
        return any(y[0] in kinds and scopes[x[1]] == scopes[y[1]] and max(y[1] - x[2], x[1] - y[2]) <= reach for y in base + weak)
    ids, secrets = ("access", "account"), ("assign", "hex", "phrase", "bare")
    need = {"account": (secrets,), "phrase": (ids,), "bare": (ids,), "endpoint": (ids, secrets)}
    kept = base + [x for x in weak if all(beside(x, kinds) for kinds in need[x[0]])]
    return sorted(kept, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def random_texts(n, seed=4, size=30):
    rng = random.Random(seed)
    marks = [
        "token", "Secret", "API_KEY", "apikey", "passwd", "password", "=", ": ", " = ", '"', "'", " ", "\n", "\n\n", "\n \t\n", "abcdef012345", "0123456789abcdef" * 2, "AKIA" + "Q7" * 8, "AKIA",
        "user", "login=", "client_id: ", "bob", "é", "😀", "K", "ſ", "https://", "host=", "db.example.org:5432", "aB3" * 7, "pass:", "pin = ", "x", ",", "word word word ",
    ]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("reach", [0, 8, 240])
def test_spans_equal_the_plain_version(reach):
    for text in random_texts(1500):
        got, _ = secret_scan.scan(text, reach)
        assert sorted(got, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))) == plain_scan(text, reach), text
        assert [s for s in got if s[0] in secret_scan.BASE] == plain_base(text)


def test_failing_matches_are_not_tried_again():
    assert secret_scan.scan("token=secret=abc")[0] == [("assign", 0, 16)]
    assert secret_scan.scan("token = ab secret=abcdef")[0] == [("assign", 11, 24)]
    assert secret_scan.scan("AKIAAKIA" + "B" * 13)[0] == [("access", 0, 21)]


def test_weak_candidates_need_their_complement():
    kinds = lambda text: {s[0] for s in secret_scan.scan(text)[0]}
    assert kinds("user: bob") == kinds("https://db.example.org aB3aB3aB3aB3aB3aB3aB3") == kinds("pin: 4711") == set()
    assert kinds("user: bob pin: 4711") == {"account", "phrase"}
    assert kinds("user: bob\n\npin: 4711") == set()
    assert kinds("user: bob" + " word" * 60 + " pin: 4711") == set()
    assert kinds("https://db.example.org user: bob aB3aB3aB3aB3aB3aB3aB3") == {"endpoint", "account", "bare"}
    assert kinds("https://db.example.org user: bob") == set()


def test_a_credential_joins_the_nearest_parts():
    text = "host=a.example.org login: bob pin: 1234\n\nAKIA" + "Q7" * 8 + " secret=abcdefgh pin=5678"
    _, credentials = secret_scan.scan(text)
    assert credentials == [(text.index("login"), text.index("pin"), 0), (text.index("AKIA"), text.index("secret"), None)]


def test_queries_digests(docs_of):
    rows = [(1, "token=abcdef1 and " + "0a" * 12), (2, None), (3, ""), (None, "user=bob pin=1234"), (1, "token=abcdef1 and " + "0a" * 12)]
    got = sorted(secret_scan.digests(secret_scan.secrets(docs_of(rows))).collect(), key=str)
    want = hashlib.sha256(b"assign:0:13,hex:18:42").hexdigest()
    assert [(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got] == [(1, 1, 0, 1), (1, 1, 0, 1), (2, 0, 0, 0), (3, 0, 0, 0), (None, 0, 0, 0)]
    assert got[0].base_sha256 == want and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans == "account:0:8,phrase:9:17" and got[4].n_credentials == 1
    assert secret_scan.digests(secret_scan.secrets(docs_of([]))).collect() == []


@pytest.mark.parametrize("piece", ["token ", "user=bob pin=1234 ", "\n", "ab1Z", "password" + " " * 50, "user=bob "])
def test_time_grows_with_the_text(piece):
    begin = time.time()
    secret_scan.scan(piece * (1_000_000 // len(piece)))
    assert time.time() - begin < 20
