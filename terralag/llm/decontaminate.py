"""Benchmark decontamination by SimHash windows of an item's size.

Texts and items are lower-cased (A-Z), cut into words at blanks and into shingles of ``width`` words (an item
with fewer words is one shingle). For every item size, each window of so many shingles in a text that could
be similar enough gets a SimHash: a similarity of ``threshold`` needs that share of the window's shingles to be
the benchmark's, so windows with fewer are not hashed. That bound is exact and loses no match. A text with fewer
shingles than an item is one window, if it has that share of the item's number, and is compared without a SimHash.

Items of the window's size are found by multi-index Hamming blocks: fingerprints are cut into 8 bytes, and each
byte's table has the items within ``radius // 8`` bits of it. Any item within ``radius`` bits differs by no more
in some byte, so all of them are met; the distance is then taken in full. Last, the exact weighted (multiset)
Jaccard similarity of the shingles, as strings, decides.

The benchmark is sent to the tasks in blocks of at most ``ITEM_BLOCK`` items, one pass over the documents each.
A task hashes ``SLICE`` bytes of text at once, a longer text by itself, and looks up ``PAIRS`` pairs of windows and
items at once, so what it holds does not grow with its rows.

Defined cases: null, empty and blank texts and items match nothing; repeated documents give a row each and
repeated items (rows with the same id) are looked up each by itself, the best one counts; of equal windows the first
counts; a null doc_id or item_id stays; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, texts, union_all

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 20
ITEM_BLOCK, REGION = 10_000, 1 << 15
#: Text hashed at once, at some 30 bytes of arrays a byte; pairs of windows and items looked up at once.
SLICE, PAIRS = 1 << 18, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_P, _PINV):
            row = np.full(1 << max(n - 1, 2 * SLICE - 1).bit_length(), base)
            row[0] = 1
            _powers.append(np.cumprod(row, out=row))
    return _powers[0], _powers[1]


class Words:
    """Texts as one row of bytes with word borders, and hashes of any run of words in it."""

    def __init__(self, texts_: list[str]):
        joined, counts = [], [0]
        for t in texts_:
            w = words_of(t)
            counts.append(len(w))
            if w:
                joined.append(b" ".join(w))
        data = np.frombuffer(b" ".join([*joined, b""]) or b" ", np.uint8)
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        sums = self.sums[1:]
        np.add(data, 1, out=sums, dtype=np.uint64)
        sums *= up[: len(data)]
        np.cumsum(sums, out=sums)
        self.data = data
        self.stops = np.flatnonzero(data == 32)
        self.starts = np.r_[0, self.stops[:-1] + 1]
        self.first = np.cumsum(counts)

    def hashes(self, width: int) -> np.ndarray:
        """A hash for the run of ``width`` words at each word; runs that reach into the next text count too."""
        n = max(int(self.first[-1]) - width + 1, 0)
        a, b = self.starts[:n], self.stops[width - 1 : width - 1 + n]
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    def run(self, word: int, count: int) -> bytes:
        return self.data[self.starts[word] : self.stops[word + count - 1]].tobytes()


def votes_to_prints(votes: np.ndarray, counts) -> np.ndarray:
    packed = np.packbits(votes * 2 > np.asarray(counts).reshape(-1, 1), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Index:
    """Items by (shingle width, number of shingles), with their shingles and byte tables."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        split = [(i, words_of(t)) for i, t in items if t]
        self.sizes: dict[tuple[int, int], dict] = {}
        for i, w in split:
            if w:
                k = min(width, len(w))
                self.sizes.setdefault((k, len(w) - k + 1), {"ids": [], "bags": [], "prints": []})
                box = self.sizes[k, len(w) - k + 1]
                h = Words([b" ".join(w).decode("utf-8", "surrogatepass")]).hashes(k)
                box["ids"].append(i)
                box["bags"].append(Counter(b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)))
                box["prints"].append(votes_to_prints(bits_of(h).sum(axis=0, dtype=np.int32)[None, :], [len(h)])[0])
                box.setdefault("hashes", []).append(h)
        self.known = {}
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= radius // 8
        for (k, _), box in self.sizes.items():
            self.known.setdefault(k, []).extend(box.pop("hashes"))
            box["prints"] = np.array(box["prints"], "<u8")
            bytes_ = box["prints"].view(np.uint8).reshape(-1, 8)
            box["near"] = [near[:, bytes_[:, j]] for j in range(8)]
        self.known = {k: np.unique(np.concatenate(h)) for k, h in self.known.items()}
        self.maybe = {}
        for k, h in self.known.items():
            self.maybe[k] = np.zeros(1 << 20, bool)
            self.maybe[k][h >> np.uint64(44)] = True

    def hits(self, hashes: np.ndarray, k: int) -> np.ndarray:
        at = np.flatnonzero(self.maybe[k][hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.known[k], hashes[at]), len(self.known[k]) - 1)
        return at[self.known[k][place] == hashes[at]]

    def lookup(self, box: dict, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(window, item, distance)`` for all pairs within the radius."""
        bytes_ = prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        found, step = [], max(1, PAIRS // len(box["ids"]))
        for at in range(0, max(len(prints), 1), step):
            met = np.zeros((len(bytes_[at : at + step]), len(box["ids"])), bool)
            for j in range(8):
                met |= box["near"][j][bytes_[at : at + step, j]]
            w, i = np.nonzero(met)
            w += at
            d = np.bitwise_count(prints[w] ^ box["prints"][i])
            ok = d <= self.radius
            found.append((w[ok], i[ok], d[ok]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def _regions(hits: np.ndarray, reach: int, stop: int):
    """Parts of a text's shingles around its hits, at most ``REGION`` window starts each."""
    cuts = np.flatnonzero(np.diff(hits) > reach) + 1
    for group in np.split(hits, cuts):
        low, high = max(int(group[0]) - reach, 0), int(group[-1]) + 1
        for a in range(low, high, REGION):
            yield a, min(a + REGION, high), min(a + REGION + reach, stop)


def matches(index: Index, words: Words, hashes: dict, hit: dict, text: int) -> dict:
    """``item id -> (similarity, distance, first word, words)`` for one text."""
    found: dict = {}
    a, b = int(words.first[text]), int(words.first[text + 1])
    for k in index.known:
        n = b - a - k + 1
        lo, hi = np.searchsorted(hit[k], (a, max(a + n, a)))
        if lo == hi:
            continue
        own = hit[k][lo:hi] - a
        for m, box in [(m, box) for (kk, m), box in index.sizes.items() if kk == k and m > n]:
            if min(n, hi - lo) >= index.threshold * m - 1e-9:
                bag, own_print = Counter(words.run(a + x, k) for x in range(n)), None
                for which, other in enumerate(box["bags"]):
                    s = similarity(other, bag)
                    if s >= index.threshold:
                        if own_print is None:
                            own_print = votes_to_prints(bits_of(hashes[k][a : a + n]).sum(axis=0, dtype=np.int32)[None, :], [n])[0]
                        found[box["ids"][which], id(box), which] = (s, int(np.bitwise_count(own_print ^ box["prints"][which])), 0, b - a)
        sizes = [(m, box) for (kk, m), box in index.sizes.items() if kk == k and m <= n]
        if not sizes:
            continue
        for r0, starts_end, r1 in _regions(own, max(m for m, _ in sizes), n):
            mask = np.zeros(r1 - r0, np.int64)
            mask[own[(own >= r0) & (own < r1)] - r0] = 1
            count = np.r_[0, np.cumsum(mask)]
            votes = None
            for m, box in sizes:
                last = min(starts_end, r1 - m + 1) - r0
                if last <= 0:
                    continue
                p = np.flatnonzero(count[m : m + last] - count[:last] >= index.threshold * m - 1e-9)
                if not len(p):
                    continue
                if votes is None:
                    votes = np.zeros((r1 - r0 + 1, 64), np.int32)
                    np.cumsum(bits_of(hashes[k][a + r0 : a + r1]), axis=0, dtype=np.int32, out=votes[1:])
                prints = votes_to_prints(votes[p + m] - votes[p], [m])
                w, item, dist = index.lookup(box, prints)
                for j in np.argsort(dist, kind="stable"):
                    which, start = int(item[j]), int(p[w[j]]) + r0 + a
                    best = found.get(key := (box["ids"][which], id(box), which))
                    if best and best[0] == 1:
                        continue
                    s = similarity(box["bags"][which], Counter(words.run(start + x, k) for x in range(m)))
                    if s >= index.threshold and (best is None or s > best[0]):
                        found[key] = (s, int(dist[j]), start - a, m + k - 1)
    out: dict = {}
    for (i, _, _), best in found.items():
        if i not in out or best[0] > out[i][0]:
            out[i] = best
    return out


_OUT = "doc_id long, item_id long, similarity double, distance int, first_word long, n_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item with a window of similarity ``threshold`` or more, the best one."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-bench.count() // ITEM_BLOCK))
    out = []
    for number in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        sent = spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
        out.append(docs.mapInArrow(_search(sent, width, threshold, radius), _OUT))
    return union_all(out)


def _search(sent, width, threshold, radius):
    def run(batches):
        index = Index(sent.value, width, threshold, radius)
        for part in slices(batches, limit=SLICE) if index.sizes else ():
            words = Words(texts(part))
            hashes = {k: words.hashes(k) for k in index.known}
            hit = {k: index.hits(h, k) for k, h in hashes.items()}
            near = np.unique(np.concatenate([np.searchsorted(words.first, h, side="right") - 1 for h in hit.values()]))
            docs_ = part.column("doc_id")
            rows = [(docs_[int(t)].as_py(), i, *best) for t in near for i, best in matches(index, words, hashes, hit, int(t)).items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; columns as they are."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]), "left_anti")
