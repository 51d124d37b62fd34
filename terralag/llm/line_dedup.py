"""Line dedup over range-partitioned line hashes, answered with keep bitmaps.

Lines are the parts of a text between ``\\n``; a null or empty text is one empty line. A line's key has
the blanks at both ends stripped and A-Z lower-cased. Keys of at least ``min_chars`` code points found
in at least ``min_docs`` documents lose all their lines except those of the largest doc_id.

Rows of (128-bit key hash, document, position) are written once, then range-partitioned and sorted by
hash, document (largest first) and position. The range covers the document too, so a line that a third
of all documents hold is spread over many partitions. Each partition is streamed: the first document
of a run stays, later ones go once ``min_docs`` documents were seen. Runs that a border may cut give a
summary of at most two rows per partition; those are stitched on the driver and settle the open rows.
The result is one compressed bitmap per document that loses lines; no text is shuffled to find it.

Defined cases: a null doc_id is a document of its own, below all others; rows that repeat a doc_id are
one document when documents are counted, and bitmaps are matched by doc_id and text hash; an empty
table gives an empty result; other columns pass through ``drop_repeated_lines`` untouched.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import free_name, slices, stage, texts

BLANK = "\t\n\x0b\x0c\r "
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_LINES = "h long, g long, doc_id long, th long, pos int"


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_LOWER) if not line.isascii() else line.strip(BLANK).lower()


def _text_hash(text: str) -> int:
    """As ``F.xxhash64`` gives it."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return x - (1 << 64) if x >> 63 else x


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h, g, doc_id, th, pos)`` for each line with a key of at least ``min_chars`` code points."""

    def run(batches):
        for part in slices(batches):
            lo, hi, doc, th, pos = [], [], [], [], []
            for d, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                mine = None
                for i, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
                        mine = _text_hash(text) if mine is None else mine
                        lo.append((x & (1 << 64) - 1) - (1 << 63))
                        hi.append((x >> 64) - (1 << 63))
                        doc.append(d)
                        th.append(mine)
                        pos.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int32())], names=["h", "g", "doc_id", "th", "pos"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _LINES)


_STREAMED = "h long, g long, doc_id long, th long, pos int, part int, kind int, rank int"
_NAMES = ["h", "g", "doc_id", "th", "pos", "part", "kind", "rank"]
_SCHEMA = pa.schema([(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(_NAMES)])
#: Kinds of streamed rows: a line that goes; lines left open in the first and the last run of a partition;
#: first and last document of the first run and of the last run, with the run's count of documents.
GOES, OPEN_FIRST, OPEN_LAST, FIRST_A, FIRST_B, LAST_A, LAST_B = range(1, 8)


class _Run:
    """The run being read; ``rank`` counts its documents so far, held at ``min_docs``.

    Held back are only rows of its first ``min_docs - 1`` documents.
    """

    def __init__(self, part: int, min_docs: int):
        self.part, self.min_docs, self.first, self.rank, self.begun, self.last, self.held = part, min_docs, True, 0, None, None, []

    def rows(self, cols, where, kind):
        n = len(cols["pos"][where])
        arrays = [pa.array(cols["h"][where]), pa.array(cols["g"][where]), pa.array(cols["doc_id"][where], mask=cols["null"][where]), pa.array(cols["th"][where]), pa.array(cols["pos"][where], pa.int32())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(np.full(n, x, np.int32)) for x in (self.part, kind)), pa.array(cols["rank"][where].astype(np.int32))], names=_NAMES)

    def edge(self, at, kind):
        row = dict(zip(_NAMES, (*at[:2], None if at[3] else at[2], None, None, self.part, kind, self.rank), strict=True))
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    def feed(self, cols, where, at):
        """More rows of the run; ``at(i)`` is the key and document of row i."""
        if not len(where):
            return
        if self.begun is None:
            self.begun = at(where[0])
        self.last, ranks = at(where[-1]), cols["rank"][where]
        self.rank = int(ranks[-1])
        if self.rank >= self.min_docs and not self.first:
            for c, w in self.held:
                yield self.rows(c, w, GOES)
            self.held.clear()
            yield self.rows(cols, where[ranks > 1], GOES)
        else:
            yield self.rows(cols, where[ranks >= self.min_docs], GOES)
            self.held.append((cols, where[(ranks < self.min_docs) & (self.first | (ranks > 1))]))

    def end(self, final=False):
        if self.first or final:
            yield self.edge(self.begun, FIRST_A if self.first else LAST_A)
            yield self.edge(self.last, FIRST_B if self.first else LAST_B)
            for c, w in self.held:
                yield self.rows(c, w, OPEN_FIRST if self.first else OPEN_LAST)
        self.first, self.rank, self.begun, self.held = False, 0, None, []


def _stream(min_docs: int):
    """Stream partitions sorted by key and document."""

    def run(batches):
        from pyspark import TaskContext

        now = _Run(TaskContext.get().partitionId(), min_docs)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            cols = {c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in _NAMES[:5]} | {"null": null}
            at = lambda i, c=cols: (int(c["h"][i]), int(c["g"][i]), int(c["doc_id"][i]), bool(c["null"][i]))
            new_run = np.r_[True, (np.diff(cols["h"]) != 0) | (np.diff(cols["g"]) != 0)]
            new_doc = np.r_[True, (np.diff(cols["doc_id"]) != 0) | (null[1:] != null[:-1])] | new_run
            goes_on = now.last is not None and at(0)[:2] == now.last[:2]
            if goes_on:
                new_run[0], new_doc[0] = False, at(0)[2:] != now.last[2:]
            starts, seen = np.flatnonzero(new_run), np.cumsum(new_doc)
            before = np.zeros(n, np.int64)
            before[starts] = seen[starts] - 1
            ranks = seen - np.maximum.accumulate(before)
            own = [*starts, n]  # rows before own[0] belong to the run being read
            ranks[: own[0]] += now.rank
            cols["rank"] = ranks = np.minimum(ranks, min_docs)
            if now.last is None:
                own = own[1:]
            yield from now.feed(cols, np.arange(own[0]), at)
            if own[0] == n:
                continue
            yield from now.end()
            whole = slice(own[0], own[-2])
            if own[-2] > own[0]:
                sizes = np.repeat([ranks[b - 1] for _, b in pairwise(own[:-1])], np.diff(own[:-1]))
                yield now.rows(cols, np.flatnonzero((ranks[whole] > 1) & (sizes >= min_docs)) + own[0], GOES)
            yield from now.feed(cols, np.arange(own[-2], n), at)
        if now.last is not None:
            yield from now.end(final=True)

    return run


def _stitch(edges: list, min_docs: int) -> list[tuple]:
    """``(part, kind, before, same, total)`` for runs that borders cut; all arguments are two rows a run.

    ``before``: documents of the run in earlier partitions; ``same``: 1 if its first document here is the
    last one there; ``total``: documents of the whole run, all held at ``min_docs``.
    """
    runs = {}
    for e in edges:
        runs.setdefault((e.part, e.kind > FIRST_B), {})[e.kind in (FIRST_A, LAST_A)] = e
    chains = []
    for (part, late), ends in sorted(runs.items()):
        a, b = ends[True], ends[False]
        if chains and chains[-1]["key"] == (a.h, a.g):
            c = chains[-1]
            c["runs"].append((part, late, c["total"], int(c["doc"] == a.doc_id)))
            c["total"] = min(min_docs, c["total"] + a.rank - int(c["doc"] == a.doc_id))
            c["doc"] = b.doc_id
        else:
            chains.append({"key": (a.h, a.g), "runs": [(part, late, 0, 0)], "total": a.rank, "doc": b.doc_id})
    return [(part, OPEN_LAST if late else OPEN_FIRST, before, same, c["total"]) for c in chains for part, late, before, same in c["runs"]]


def _pack(positions: list[int]) -> bytes:
    keep = np.ones(max(positions) // 8 * 8 + 8, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def keep_mask(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of ``n`` lines stays; no bitmap, and lines past its end, stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, th, bitmap)`` for documents that lose lines; ``th`` is ``xxhash64`` of the text."""
    spark = docs.sparkSession
    lines = stage(line_hashes(docs, min_chars), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h"), F.col("g"), F.col("doc_id").desc()]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "pos")
    streamed = stage(ranged.mapInArrow(_stream(min_docs), _STREAMED), "streamed")
    cut = _stitch(streamed.where(F.col("kind") >= FIRST_A).collect(), min_docs)
    cut = spark.createDataFrame(cut, "part int, kind int, before int, same int, total int")
    still = streamed.where(F.col("kind").isin(OPEN_FIRST, OPEN_LAST)).join(F.broadcast(cut), ["part", "kind"])
    still = still.where((F.col("before") + F.col("rank") - F.col("same") > 1) & (F.col("total") >= min_docs))
    gone = streamed.where(F.col("kind") == GOES).select("doc_id", "th", "pos").unionByName(still.select("doc_id", "th", "pos"))
    grouped = gone.distinct().groupBy("doc_id", "th").agg(F.collect_list("pos").alias("pos"))

    def pack(batches):
        for b in batches:
            bits = pa.array([_pack(p) for p in b.column("pos").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), bits], names=["doc_id", "th", "bitmap"])

    return grouped.mapInArrow(pack, "doc_id long, th long, bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, out: str = "bitmap") -> DataFrame:
    """``docs`` with a column ``out``, null where nothing goes."""
    b = bitmaps.withColumnRenamed("bitmap", out)
    match = docs["doc_id"].cast("long").eqNullSafe(b["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == b["th"])
    return docs.join(b, match, "left").select(*[docs[c] for c in docs.columns], b[out])


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; texts that lose nothing are unchanged."""
    other, name = [c for c in docs.columns if c != "text"], free_name(docs, "bitmap")

    def cut(batches):
        for part in slices(batches):
            out = []
            for text, bitmap in zip(part.column("text").to_pylist(), part.column(name).to_pylist(), strict=True):
                if bitmap is not None:
                    lines = (text or "").split("\n")
                    text = "\n".join([x for x, k in zip(lines, keep_mask(bitmap, len(lines)), strict=True) if k])
                out.append(text)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in other), pa.array(out, pa.string())], names=[*other, "text"])

    both = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), name).select(*other, "text", name)
    schema = docs.select(*other, "text").schema
    return both.mapInArrow(cut, schema).select(*docs.columns)
