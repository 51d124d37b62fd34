"""Importance resampling against a plain version over all texts."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from terralag.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text, width=2):
    w = plain_words(text)
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def plain_ranks(rows, target, buckets=10_000, min_words=20, percent=25, seed=7):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in plain_features(x)) for xs in ([x for _, x in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        f = plain_features(x)
        weight = math.floor(sum(gain(bucket(y)) for y in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(plain_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = n
    return sorted(map(tuple, out), key=str)


def random_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["Ab", "ab", "é", "Éa", "x1", "日本", "zz", "😀", "K", "the", "The", "of"]
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "-", "\x00", "", ", "]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 16])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_windows_of_chunks(chunk, width):
    for text in ["", " ", "one", "One two", "a b c d e", *random_texts(40)]:
        n, found = resample.text_buckets(text, 1 << 20, width, chunk)
        assert n == len(plain_words(text))
        assert sorted(found.tolist()) == sorted(crc32(f.encode()) % (1 << 20) for f in plain_features(text, width))


def test_offsets_name_the_words():
    text = "The Étude, x1  日本-zz\x00😀 end"
    for chunk in (3, 1000):
        found = [x for part in resample.word_chunks(text, chunk) for x in part]
        assert [w for w, _ in found] == plain_words(text)
        assert [plain_words(text[a:b]) for _, (a, b) in found] == [[w] for w, _ in found]


def test_ranks_equal_the_plain_version(docs_of, spark):
    rows = [(i, t) for i, t in enumerate(random_texts(150))]
    rows += [(900, None), (901, ""), (902, "!!"), (None, "the of " * 30), (903, "the of " * 30), (904, "word " * 40_000), (7, rows[7][1]), (7, rows[7][1])]
    target = [(0, "the of the zz"), (1, None), (2, "Ab ab the")]
    got = resample.importance_ranks(docs_of(rows), docs_of(target)).collect()
    want = plain_ranks(rows, [t for _, t in target])
    assert sorted((tuple(r) for r in got), key=str) == want
    drawn = resample.resample(docs_of(rows[:140]), docs_of(target)).collect()
    want = {r[0]: r[5] for r in plain_ranks(rows[:140], [t for _, t in target]) if r[5]}
    assert {r.doc_id: r["rank"] for r in drawn} == want and all(r.text == rows[r.doc_id][1] for r in drawn)


def test_ties_go_to_the_smaller_id(docs_of, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda doc_id, seed: 0)
    rows = [(i, "a b c d " * 6) for i in range(40, 0, -1)]
    ranks = resample.importance_ranks(docs_of(rows), docs_of([(0, "a b")])).collect()
    assert {r.doc_id: r["rank"] for r in ranks if r["rank"]} == {i: i for i in range(1, 11)}


def test_empty_tables(docs_of):
    assert resample.importance_ranks(docs_of([]), docs_of([(0, "a b")])).collect() == []
    ranks = resample.importance_ranks(docs_of([(1, "a " * 30), (2, "b " * 30)]), docs_of([])).collect()
    assert sorted(r.doc_id for r in ranks) == [1, 2] and all(r["rank"] is None for r in ranks)


def test_gains_follow_the_formula():
    class Rows(list):
        def collect(self):
            return self

    class Row:
        def __init__(self, bucket, n):
            self.bucket, self.n = bucket, n

    gains = resample.bucket_gains(Rows([Row(0, 5), Row(2, 1)]), Rows([Row(2, 3)]), 4)
    assert gains.tolist() == [math.floor(1000 * math.log(x)) for x in (1 * 10 / (6 * 7), 10 / 7, 4 * 10 / (2 * 7), 10 / 7)]
    assert gains.dtype == np.int64
