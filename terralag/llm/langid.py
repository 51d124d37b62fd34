"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; every run of characters that are no letters counts as one blank. The n-grams of
1 to 3 characters are hashed into ``buckets``. A text's vector is term share times inverse document
frequency (L1-normalised counts), so a text is scored position by position without building its
vocabulary. Document frequencies come from all training rows; classes are all non-null languages there.
The weights are fitted by follow-the-regularised-leader with elastic-net penalties on at most
``per_class`` rows of each language (a documented bound), four fifths of which are fitted and one fifth
sets the temperature of the softmax.

Defined cases: a text that is null or has no letter is ``und`` with score 0, also when nothing was
learned; rows with a null lang are predicted, never learned from; repeated rows are predicted one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, texts

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
PER_CLASS, EPOCHS = 400, 12
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, one for each order and position."""
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(_MIX[i])
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(7)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int32)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of texts with each bucket; the last entry is the number of texts."""

    def run(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for part in slices(batches):
            for t in texts(part):
                if has_letter(t):
                    total[:BUCKETS] += np.bincount(grams(t), minlength=BUCKETS) > 0
                    total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)  # at most BUCKETS + 1 rows, whatever the input
    for r in rows:
        out[r.bucket] = r.n
    return out


def sample(docs: DataFrame, classes: dict[str, int], per_class: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About ``per_class`` texts of each language at most, as ``(lang, buckets, counts)``, dealt by a hash."""
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_class / n)) for k, n in classes.items()])
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    drawn = drawn.select("doc_id", "lang", F.col("text").cast("string"))

    def run(batches):
        for part in slices(batches):
            rows = []
            for d, lang, t in zip(part.column("doc_id").to_pylist(), part.column("lang").to_pylist(), texts(part), strict=True):
                if has_letter(t):
                    at, n = np.unique(grams(t), return_counts=True)
                    rows.append((d, lang, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "lang", "at", "n"])

    got = drawn.mapInArrow(run, "doc_id long, lang string, at binary, n binary").limit(2 * per_class * len(classes)).collect()
    got.sort(key=lambda r: (r.doc_id is not None, r.doc_id, r.at))
    return [(r.lang, np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i4")) for r in got]


def ftrl(rows: list, labels: list[int], n_classes: int, idf: np.ndarray, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal weights ``(buckets + 1, classes)``; the last row is the bias, which has no penalty."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zz, free = z[at], (at == BUCKETS)[:, None]
        shrunk = np.where(free, zz, np.sign(zz) * np.maximum(np.abs(zz) - l1, 0))
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0, l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


class Model:
    """Classes, one weight table over buckets (inverse document frequencies included), bias, temperature."""

    def __init__(self, classes: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.classes, self.table, self.bias, self.temperature = classes, table, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        at = grams(text)
        return (self.table[at].sum(axis=0, dtype=np.float64) / len(at) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return "und", 0.0
        p = self.logits(text)
        p = np.exp(p - p.max())
        best = int(p.argmax())
        return self.classes[best], float(p[best] / p.sum())


def _scale(idf):
    return 100.0 * idf  # shares of n-grams are small numbers


def fit(train: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``train(doc_id, text, lang)``; rows with a null lang are left out."""
    train = train.select("doc_id", "text", F.col("lang").cast("string")).where("lang is not null")
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df = document_frequencies(train)
    idf = _scale(np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1)
    rows, labels = [], []
    for lang, at, n in sample(train, counts, per_class):
        rows.append((np.r_[at, BUCKETS], np.r_[n / n.sum() * idf[at], 1.0]))
        labels.append(classes.index(lang))
    held = [i for i in range(len(rows)) if i % 5 == 4]
    kept = [i for i in range(len(rows)) if i % 5 != 4]
    w = ftrl([rows[i] for i in kept], [labels[i] for i in kept], len(classes), idf)
    temperature = calibrate(np.array([rows[i][1] @ w[rows[i][0]] for i in held]).reshape(-1, len(classes)), np.array([labels[i] for i in held], int))
    return Model(classes, (w[:BUCKETS] * idf[:, None]).astype(np.float32), w[BUCKETS], temperature)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that were not fitted; 1 without any."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return (np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]).mean()

    return float(min(grid, key=loss))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score under ``names``; only ``text`` is looked at."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.classes, model.table, model.bias, model.temperature))  # BUCKETS x classes numbers
    other = [c for c in docs.columns if c not in names]

    def run(batches):
        m = Model(*sent.value)
        for part in slices(batches):
            got = [m.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in other), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*other, *names])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.select(*other).schema)).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.select(*other).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))
