"""Token counts of whole texts; huge texts by overlapping chunks spliced at proven boundaries.

A text of at most ``chunk`` code points is counted in place, part by part (see ``tokens``). A longer
one becomes chunks of ``chunk`` code points plus an overlap, dealt over all tasks and encoded with
offsets. Where the pre-tokenizer starts a match in both of two neighbours, at least ``GUARD`` code
points away from the left one's end and the right one's start, it starts one in the whole text: it
keeps no state, looks one character ahead, and no special string reaches that far. The last such place
splices the pair. Texts with a pair that has none (a word longer than the overlap, say) are cut again
with overlaps four times as wide, until they align or one chunk holds the text.

For sentencepiece models, whose words are not found by a pattern, texts are encoded whole.

Defined cases: null counts as the empty text, with no tokens; special strings inside texts are what the
library makes of them; repeated rows are counted one by one; a null doc_id stays; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralag.llm.common import slices, stage, texts
from terralag.llm.tokens import PartCache, load

CHUNK, OVERLAP, GUARD = 32_768, 512, 32
_OUT = ["doc_id", "n_bytes", "n_tokens", "row", "text"]


def boundaries(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Places where a pre-token starts, the tokens before each, and the tokens of ``text``."""
    enc = tokenizer.encode(text, add_special_tokens=False)
    words = enc.word_ids
    starts = [i for i in range(1, len(words)) if words[i] != words[i - 1]]
    offsets = enc.offsets
    return np.array([offsets[i][0] for i in starts], np.int64), np.array(starts, np.int64), len(words)


def _whole(path: str, chunk: int):
    """Counts of texts up to ``chunk``; a longer one passes with its text and a number of its own."""

    def run(batches):
        from pyspark import TaskContext

        tokenizer, part, n = load(path), TaskContext.get().partitionId(), 0
        if path.endswith(".model"):
            count = lambda ts: [len(x) for x in tokenizer.encode(ts, num_threads=1)]
        else:
            cache = PartCache(lambda ps: [len(x) for x in tokenizer.encode_batch(ps, add_special_tokens=False)])
            count = lambda ts: [sum(x) for x in cache.look_up(ts)]
        for b in slices(batches):
            ts = texts(b)
            long = [len(t) > chunk and not path.endswith(".model") for t in ts]
            got = iter(count([t for t, x in zip(ts, long, strict=True) if not x]))
            rows = []
            for t, x in zip(ts, long, strict=True):
                n += x
                rows.append((len(t.encode("utf-8", "surrogatepass")), None if x else next(got), (part << 40) + n if x else None, t if x else None))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=_OUT)

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                starts = [0]
                while starts[-1] + chunk + overlap < len(text):
                    starts.append(starts[-1] + chunk)
                for i, s in enumerate(starts):
                    piece = text[s : s + chunk + overlap]
                    yield pa.RecordBatch.from_pylist([{"row": row, "no": i, "start": s, "piece": piece, "last": i + 1 == len(starts)}], schema=pa.schema([("row", pa.int64()), ("no", pa.int32()), ("start", pa.int64()), ("piece", pa.string()), ("last", pa.bool_())]))

    return run


def _encode(path: str, chunk: int, overlap: int):
    """Tokens before each safe boundary in the two overlaps of a chunk."""

    def run(batches):
        tokenizer = load(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                at, before, n = boundaries(tokenizer, r["piece"])
                head = (at >= GUARD) & (at < overlap)
                tail = (at >= chunk + GUARD) & (at <= len(r["piece"]) - GUARD)
                pair = lambda w, r=r, at=at, before=before: [{"at": int(x) + r["start"], "before": int(y)} for x, y in zip(at[w], before[w], strict=True)]
                out.append({"row": r["row"], "no": r["no"], "last": r["last"], "n": n, "head": pair(head) if r["no"] else [], "tail": [] if r["last"] else pair(tail)})
            spot = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("no", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), ("head", spot), ("tail", spot)]))

    return run


_SPOTS = "array<struct<at:long,before:long>>"


def chunked_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``long(row, text)`` to ``(row, n_tokens)``, null where two chunks have no common boundary."""
    spark = long.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = long.select("row", "text").mapInArrow(_chunks(chunk, overlap), "row long, no int, start long, piece string, last boolean")
    seen = cut.repartition(parts, "row", "no").mapInArrow(_encode(path, chunk, overlap), f"row long, no int, last boolean, n long, head {_SPOTS}, tail {_SPOTS}")
    w = Window.partitionBy("row").orderBy("no")
    met = F.array_max(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform(F.lead("head").over(w), lambda x: x["at"])))
    seen = seen.withColumn("cut", F.when(~F.col("last"), met)).withColumn("from", F.lag("cut").over(w))
    at = lambda spots, place: F.get(F.filter(spots, lambda x: x["at"] == place), F.lit(0))["before"]
    stop = F.when(F.col("last"), F.col("n")).otherwise(at("tail", F.col("cut")))
    begin = F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(at("head", F.col("from")))
    done = seen.select("row", (stop - begin).alias("n"))
    return done.groupBy("row").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row of ``docs``; ``chunk`` is at least ``overlap``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = stage(docs.mapInArrow(_whole(path, chunk), "doc_id long, n_bytes long, n_tokens long, row long, text string"), "counts")
    found, long = [], first.where("row is not null").select("row", "text")
    while not long.isEmpty():
        counts = stage(chunked_counts(long, path, chunk, overlap), "chunks")
        found.append(counts.where("n_tokens is not null"))
        long = long.join(counts.where("n_tokens is null").select("row"), "row", "left_semi")
        overlap *= 4
        chunk = max(chunk, overlap)
    out = first.select("doc_id", "n_bytes", "n_tokens", "row")
    for counts in found:
        out = out.join(counts.withColumnRenamed("n_tokens", "more"), "row", "left")
        out = out.withColumn("n_tokens", F.coalesce("n_tokens", "more")).drop("more")
    return out.select("doc_id", "n_bytes", "n_tokens")
