"""Target-distribution importance resampling over hashed word n-grams.

A text is lower-cased (A-Z) and cut into words by an untrained Regex Split of ``tokenizers``, which returns words with
their offsets. The words of a chunk are joined by one blank; pairs of a start and an end offset there are the windows of
1 to ``width`` consecutive words, and the CRC-32 of a window's bytes names its bucket. A window that crosses chunks
belongs to the later one. Texts are tokenised once: each document's buckets are staged.

Bucket histograms of all documents and of all target texts are pre-aggregated in each task; their size is the number of
buckets, whatever the input, so the table of gains is collected and broadcast. A document's weight is the floored mean
of its windows' gains, its score the weight with Gumbel noise drawn from a hash of its id; the highest scores of the
documents with enough words are drawn. Ranks come from a range-partitioned sort, never from one task.

Defined cases: null, empty and wordless texts have no features and weight 0; a null doc_id hashes as the empty text and
comes last among equal scores; repeated rows are weighed and drawn one by one, in any order among themselves; without
target texts every gain compares with an empty histogram; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import positions, slices, stage, texts

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, WIDTH, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Characters tokenised at once; a longer chunk only holds a longer word.
CHUNK = 1 << 16
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_splitter = None


def word_chunks(text: str, chunk: int = CHUNK) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """The words of a text with their offsets in it, some at a time."""
    global _splitter
    if _splitter is None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        _splitter = Split(Regex(PATTERN), behavior="removed", invert=True)
    text = text.encode("utf-8").lower().decode("utf-8")
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + chunk) if at + chunk < len(text) else None
        end = gap.start() if gap else len(text)
        found = _splitter.pre_tokenize_str(text[at:end])
        yield [(w, (a + at, b + at)) for w, (a, b) in found] if at else found
        at = end


def text_buckets(text: str, buckets: int = BUCKETS, width: int = WIDTH, chunk: int = CHUNK) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every window of 1 to ``width`` words."""
    n, carry, out = 0, [], []
    for found in word_chunks(text, chunk):
        if not found:
            continue
        new = [w.encode() for w, _ in found]
        n += len(new)
        words, old = carry + new, len(carry)
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends.tolist()
        for more in range(min(width, len(words))):  # windows of more + 1 words that end in a new one
            pairs = zip(starts[max(old - more, 0) :], ends[max(old, more) :], strict=False)
            out.append(np.fromiter((crc32(joined[a:b]) for a, b in pairs), np.uint32))
        carry = words[len(words) - width + 1 :] if len(words) >= width else words
    return n, np.concatenate(out) % buckets if out else np.zeros(0, np.uint32)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, buckets)``, one row per row of ``docs``; buckets are little-endian numbers."""
    kind = _kind(buckets)

    def run(batches):
        for part in slices(batches):
            found = [text_buckets(t, buckets, width) for t in texts(part)]
            n, packed = [x for x, _ in found], [x.astype(kind).tobytes() for _, x in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "buckets"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_words long, buckets binary")


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all rows of :func:`features`; a task sends each bucket at most once."""
    kind = _kind(buckets)

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("buckets").to_pylist():
                counts += np.bincount(np.frombuffer(x, kind), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths of a nat, with one more in every bucket of either histogram."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, source), (t, target)):
        for r in table.collect():  # one row per bucket at most
            counts[r.bucket] = r.n
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(((x + 1.0) * all_s) / ((y + 1.0) * all_t))) for x, y in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, fixed by the id."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(sent, buckets: int, seed: int):
    kind = _kind(buckets)

    def run(batches):
        gains = sent.value
        for batch in batches:
            sizes, weights, scores = [], [], []
            for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                own = gains[np.frombuffer(x, kind)]
                sizes.append(len(own))
                weights.append(int(own.sum()) // len(own) if len(own) else 0)
                scores.append(weights[-1] + noise(d, seed))
            cols = [batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, pa.int64()) for c in (sizes, weights, scores))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def importance_ranks(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, width: int = WIDTH, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``, one row per row of ``docs``.

    ``target`` has a ``text`` column. Of the N documents with at least ``min_words`` words, the
    ``floor(percent * N / 100)`` with the highest scores have a rank from 1.
    """
    own = stage(features(docs, buckets, width), "features")
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), buckets, width)
    gains = bucket_gains(histogram(own, buckets), histogram(aim, buckets), buckets)
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    scored = own.mapInArrow(_weigh(sent, buckets, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    # documents with too few words sort behind all others and are never drawn
    able = F.col("n_words") >= min_words
    placed = positions(scored, [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "rank")
    drawn = placed.where(able).count() * percent // 100
    rank = F.when(able & (F.col("rank") < drawn), F.col("rank") + 1)
    return placed.withColumn("rank", rank)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns and their rank; ids are taken to be unique."""
    ranks = importance_ranks(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_id"), "rank")
    return docs.drop("rank").join(ranks, F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))).drop("_id")
