"""What a task of the pipeline holds besides its rows stays small, however many rows come at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from terralag.llm import decontaminate, simhash_dedup

MB = 1 << 20


class Sent:
    def __init__(self, value):
        self.value = value


@pytest.fixture(scope="module")
def batch():
    """6 MB of texts in one batch; the first ones hold an item."""
    rng = random.Random(5)
    rows = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(300)) for _ in range(3400)]
    rows[:4] = [rows[i] + " " + " ".join(f"item{i}x{j}" for j in range(40)) for i in range(4)]
    n = len(rows)
    assert sum(map(len, rows)) > 5.5 * MB
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(rows), pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64())], names=["doc_id", "text", "th", "th2"])


def traced(run):
    """Result of ``run`` and the most that Python and numpy held meanwhile, in MB."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_decontamination_holds_little(batch, monkeypatch):
    monkeypatch.setattr(decontaminate, "_powers", [])
    items = [(i, " ".join(f"item{i}x{j}" for j in range(40))) for i in range(4)]
    found, peak = traced(lambda: list(decontaminate._search(Sent(items), 5, 0.8, 20)(iter([batch]))))
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for b in found for r in b.to_pylist()) == [(i, i, 1.0) for i in range(4)]
    assert peak < 32


def test_lookup_holds_little():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{rng.integers(3000)}" for _ in range(30))) for i in range(400)]
    index = decontaminate.Index(items, 5, 0.8, decontaminate.RADIUS)
    box = index.sizes[5, 26]
    prints = rng.integers(0, 1 << 63, 20_000, np.uint64)
    prints[7::1000] = box["prints"][3]
    (w, i, d), peak = traced(lambda: index.lookup(box, prints))
    apart = np.bitwise_count(prints[:, None] ^ box["prints"][None, :])
    assert np.array_equal(np.argwhere(apart <= decontaminate.RADIUS), np.c_[w, i]) and np.array_equal(d, apart[w, i])
    assert peak < 48


def test_lookup_of_no_window():
    index = decontaminate.Index([(1, "some words of an item that are more than five")], 5, 0.8, decontaminate.RADIUS)
    ((_, box),) = index.sizes.items()
    assert [len(x) for x in index.lookup(box, np.zeros(0, np.uint64))] == [0, 0, 0]


@pytest.mark.parametrize("step", ["sketch", "shingles"])
def test_sketches_hold_little(batch, step):
    counts = np.zeros(simhash_dedup.SLOTS, np.int32)
    run = {"sketch": lambda: simhash_dedup._sketch(Sent(counts), 0.8, simhash_dedup.HOT), "shingles": lambda: simhash_dedup._shingles}[step]()
    n, peak = traced(lambda: sum(b.num_rows for b in run(iter([batch]))))
    assert n == batch.num_rows
    assert peak < 24


def test_similar_pairs_hold_little():
    rng = np.random.default_rng(4)
    a = [np.sort(rng.integers(0, 1 << 63, 400, np.uint64)) for _ in range(2000)]
    near = [x.tobytes() if i % 2 else x[:200].tobytes() for i, x in enumerate(a)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array([x.tobytes() for x in a], pa.binary()), pa.array(near, pa.binary())], names=["a", "b", "sa", "sb"])
    kept, peak = traced(lambda: [r["a"] for b in simhash_dedup._similar(0.8)(iter([batch])) for r in b.to_pylist()])
    assert kept == list(range(1, 2000, 2))
    assert peak < 4
