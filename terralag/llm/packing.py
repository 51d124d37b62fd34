"""Packing token ids into sequences of a fixed size, online and in bounded space.

Each partition keeps at most ``windows`` open sequences. A text's ids are followed by an end id and cut
into whole sequences, which are closed at once, and a rest. The rest goes whole into the open window it
fits best. When it fits none, the fullest window is filled up with the rest's first ids and emitted, and
what remains opens a window. At the end of a partition its open windows are merged into full sequences;
the one remainder of each partition is merged with those of ``fan`` neighbours, and so on until one
group is left, whose remainder is cut at powers of two (777 ids: 512, 256, 8, 1), which need no padding.
So sequences carry no padding at all, and no task holds more than ``fan`` remainders.

Sequence ids are made of the level, the partition and a running number, so a task that runs again after
a lost executor gives the same ones. Order and cuts follow the order of rows in a partition.

Defined cases: null is the empty text, whose only id is the end id; repeated rows are packed one by one
and get a row number; a null doc_id stays; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, stage, texts, union_all
from terralag.llm.tokens import PartCache, id_bytes

SIZE, WINDOWS, FAN = 1024, 64, 256
#: Text cut into parts and encoded at once.
SLICE = 1 << 18
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, row long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
#: A sequence id is level << 58 | partition << 34 | running number.
_LEVEL, _PART = 58, 34


class Packer:
    """Open windows of one partition. A piece is ``(doc_id, row, start, doc_tokens, ids)``."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.windows, self.next, self.open, self.out = size, windows, base, [], []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, row, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc, row, start, n, total, ids, self.next, offset))
            offset += n
        self.next += 1

    @staticmethod
    def split(piece, n: int):
        doc, row, start, total, ids = piece
        return (doc, row, start, total, ids[: 4 * n]), (doc, row, start + n, total, ids[4 * n :])

    def place(self, piece) -> None:
        doc, row, start, total, ids = piece
        whole = len(ids) // (4 * self.size) * self.size
        for at in range(0, whole, self.size):
            self.emit([(doc, row, start + at, total, ids[4 * at : 4 * (at + self.size)])])
        if whole:
            piece = (doc, row, start + whole, total, ids[4 * whole :])
        n = len(piece[4]) // 4
        if not n:
            return
        fits = [w for w in self.open if w[0] + n <= self.size]
        if fits:
            best = max(fits, key=lambda w: w[0])
            best[0] += n
            best[1].append(piece)
            if best[0] == self.size:
                self.open.remove(best)
                self.emit(best[1])
        elif len(self.open) < self.windows:
            self.open.append([n, [piece]])
        else:
            full = max(self.open, key=lambda w: w[0])
            head, piece = self.split(piece, self.size - full[0])
            self.open.remove(full)
            self.emit([*full[1], head])
            self.open.append([len(piece[4]) // 4, [piece]])

    def merge(self) -> list:
        """Close what is open into full sequences; the pieces that don't fill one are returned."""
        rest, used = [], 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for piece in pieces:
                if used + len(piece[4]) // 4 >= self.size:
                    head, piece = self.split(piece, self.size - used)
                    self.emit([*rest, head])
                    rest, used = [], 0
                if piece[4]:
                    rest.append(piece)
                    used += len(piece[4]) // 4
        self.open = []
        return rest

    def finish(self, rest: list) -> None:
        """Emit ``rest`` as sequences whose sizes are powers of two."""
        left = sum(len(p[4]) // 4 for p in rest)
        while left:
            want = 1 << left.bit_length() - 1
            left -= want
            now = []
            while want:
                n = min(want, len(rest[0][4]) // 4)
                head, tail = self.split(rest[0], n)
                now.append(head)
                rest = [tail, *rest[1:]] if tail[4] else rest[1:]
                want -= n
            self.emit(now)

    def taken(self):
        rows, self.out = self.out, []
        return _batch(rows)


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def _rest_rows(rest, part):
    """Pieces that wait for the next level: no sequence yet, the partition in its place."""
    return _batch([(doc, row, start, len(ids) // 4, total, ids, -part - 1, i) for i, (doc, row, start, total, ids) in enumerate(rest)])


def _online(path: str, end_id: int, size: int, windows: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, cache, row = Packer(size, windows, part << _PART), PartCache(id_bytes(path)), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, limit=SLICE):
            for doc, values in zip(b.column("doc_id").to_pylist(), cache.look_up(texts(b)), strict=True):
                ids = b"".join([*values, end])
                packer.place((doc, (part << _PART) + row, 0, len(ids) // 4, ids))
                row += 1
            yield packer.taken()
        rest = packer.merge()
        yield packer.taken()
        yield _rest_rows(rest, part)

    return run


def _merge(size: int, level: int, last: bool):
    """Merge the remainders of a group; one group is one value of ``box``."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
        box = rows[0]["box"]
        packer = Packer(size, 1, (level << _LEVEL) + (box << _PART))
        packer.open = [[r["length"], [(r["doc_id"], r["row"], r["start"], r["doc_tokens"], r["ids"])]] for r in rows]
        packer.open.sort(key=lambda w: -w[0])
        rest = packer.merge()
        if last:
            packer.finish(rest)
            rest = []
        return pa.Table.from_batches([packer.taken(), _rest_rows(rest, box)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, windows: int = WINDOWS, end_id: int = 0, fan: int = FAN) -> DataFrame:
    """Pieces ``(doc_id, row, start, length, doc_tokens, ids, sequence_id, offset)``; ids are little-endian."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    now = stage(docs.mapInArrow(_online(path, end_id, size, windows), _DDL), "pieces")
    done, level = [], 1
    while True:
        done.append(now.where("sequence_id >= 0"))
        left = now.where("sequence_id < 0").withColumn("part", -F.col("sequence_id") - 1)
        boxes = left.agg(F.max("part")).first()[0]
        if boxes is None:
            return union_all(done)
        left = left.withColumn("box", F.floor(F.col("part") / fan).cast("long"))
        now = stage(left.groupBy("box").applyInArrow(_merge(size, level, boxes < fan), _DDL), "rests")
        level += 1


def pieces(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in the ids' place."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
