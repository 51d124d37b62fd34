"""SimHash near-duplicates by covering locality-sensitive hashing.

A text is lower-cased (A-Z), cut into words at blanks and into word shingles, repeats included; a
shingle's XXH64 votes on every bit and a bit is set when more than half of the shingles set it.
Texts link when their fingerprints differ in at most ``radius`` bits.

Covering hashing finds all such pairs: bit position i gets a non-zero vector of ``radius + 1`` bits,
and table v keeps the positions whose vector has an odd product with v. At most ``radius``
differing positions span at most ``radius`` dimensions, so some non-zero v is orthogonal to all of
them, and its table gives both fingerprints the same key.

Only distinct fingerprints are paired. Buckets with one fingerprint are dropped by an aggregate. A
bucket above ``bucket_limit`` fingerprints is not compared: its free bits are cut into
``radius + 1`` blocks, of which a linked pair shares at least one whole, and it is dealt again on
mask plus block, as often as needed. Nothing is capped. Inside a bucket a star to the smallest
fingerprint per linked group is emitted, never all pairs.

``similar_groups`` finds groups by an exact similarity of word shingles: links of the fingerprints come first, and a join
over rare shingles, which misses no similar pair, adds those that lie too far apart for fingerprints.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a text with
fewer words than a shingle is one shingle; repeated rows and equal texts share a fingerprint; a null
doc_id is kept and never names a component that has another id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import components, slices, stage, texts, union_all, unstage

BITS = 64
BUCKET_LIMIT = 1024
#: Slots of the shingle counts; places of a text's bitmap at most; texts of a short list; texts and shingles of a block.
SLOT_BITS, SLOT_ROW, BITMAP, SHORT = 22, 1 << 12, 1 << 17, 32
SLOTS, TEXT_BLOCK, BLOCK_SHINGLES = 1 << SLOT_BITS, 256, 1_000_000
#: Text or shingles handled at once inside a task: hashes in lists and their bits take some 100 bytes a byte of text.
SLICE = 1 << 18
#: Texts whose prefixes a task remembers having sent; texts of a key that go to one task.
SENT, HOT = 1 << 16, 20_000


def shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fold(hashes: list[list[int]]) -> np.ndarray:
    """One signed fingerprint for each list of hashes."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(sizes.sum()))
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(votes * 2 > sizes[full][:, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; texts never leave their partition."""

    def run(batches):
        for part in slices(batches, limit=SLICE):
            fp = fold([shingle_hashes(t, width) for t in texts(part)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks of the covering tables; position i has vector ``i mod (2^(radius+1) - 1) + 1``."""
    n = (1 << radius + 1) - 1
    odd = lambda v, i: ((i % n + 1) & v).bit_count() & 1
    return [sum(1 << i for i in range(BITS) if odd(v, i)) for v in range(1, n + 1)]


def _finer(mask: int, blocks: int) -> list[int]:
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j::blocks]) for j in range(blocks)]


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place of a symmetric matrix with a true diagonal."""
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(axis=1)
        if (new == label).all():
            return label
        label = new[new]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Stars to the smallest fingerprint per linked group."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column("fps").to_pylist():
                fps = np.unique(np.array(fps, dtype=np.int64))
                label = _labels(np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius)
                move = label != np.arange(len(fps))
                a.append(fps[move])
                b.append(fps[label[move]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = 3, bucket_limit: int = BUCKET_LIMIT, stage=stage) -> DataFrame:
    """``fps(fp)`` of distinct longs to links ``(a, b)`` with the components of all pairs in the radius."""
    masks, rows, found = dict(enumerate(covering_masks(radius))), fps.select("fp"), []
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for t, m in masks.items()])
    rows = rows.select("fp", F.inline(tables)).selectExpr("t", "fp & mask as key", "fp")
    while True:
        size = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        met = stage(rows.join(size, ["t", "key"]), "buckets")
        small = met.where(F.col("n") <= bucket_limit).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(small.select("fps").mapInArrow(_stars(radius), "a long, b long"))
        hot = met.where(F.col("n") > bucket_limit)
        used = [r.t for r in hot.select("t").distinct().collect()]
        if not used:
            return union_all(found)
        finer, deal = {}, []
        for t in used:
            for mask in _finer(masks[t], radius + 1):
                deal.append((t, len(finer), _signed(mask)))
                finer[len(finer)] = mask
        masks = finer
        deal = fps.sparkSession.createDataFrame(deal, "t int, u int, mask long")
        # a bucket keeps its old key through the mask, which contains the old mask
        rows = hot.select("t", "fp").join(F.broadcast(deal), "t").selectExpr("u as t", "fp & mask as key", "fp")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest doc_id reachable over links, itself included."""
    prints = stage(fingerprints(docs, width), "prints")
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(near_links(own, radius, bucket_limit)).withColumnRenamed("node", "fp")
    linked = stage(own.join(labels, "fp"), "labels")
    first = linked.groupBy("label").agg(F.min("first_id").alias("low_id"))
    best = linked.join(first, "label").select("fp", "low_id")
    ids = own.join(best, "fp", "left").select("fp", F.coalesce("low_id", "first_id").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches):
    """Texts per slot of the hashed shingles, in rows of ``SLOT_ROW`` slots."""
    counts = np.zeros(SLOTS, np.int32)
    for part in slices(batches, limit=SLICE):
        for t in texts(part):
            np.add.at(counts, _slot(_distinct_shingles(t)), 1)
    rows = counts.reshape(-1, SLOT_ROW)
    used = np.flatnonzero(rows.any(axis=1))
    for at in range(0, len(used), 64):
        some = used[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["place", "counts"])


def _sum_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
    packed = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
    return pa.table({"place": table.column("place")[:1], "counts": pa.array([packed], pa.binary())})


def slot_counts(docs: DataFrame) -> np.ndarray:
    """About how many texts hold the shingles of each slot; an array of fixed size, whatever the input."""
    rows = docs.select("text").mapInArrow(_slot_counts, "place long, counts binary")
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.int32)
    for r in rows.groupBy("place").applyInArrow(_sum_counts, "place long, counts binary").toLocalIterator():
        out[r.place] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def _distinct_shingles(text: str) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, 5), np.uint64))


def _sketch(sent, threshold: float, hot: int):
    """Fingerprint, number of distinct 5-word shingles, prefix and bitmap of each text.

    A similarity of ``threshold`` needs ``ceil(threshold * size)`` common shingles, so under any order of all
    shingles two such texts share one of their first ``size - ceil(threshold * size) + 1``: the prefix. The order is
    by ``sent``'s counts, rare first, so common passages are seldom in a prefix. A key that may have over ``hot`` texts is
    dealt to several tasks by a salt, which is -1 for all others. A text that the task has sketched already gets no prefix again. The bitmap has the parity of the shingles at each place: two differ in no more places than
    the sets in shingles.
    """

    def run(batches):
        counts, done = sent.value, set()
        for part in slices(batches, limit=SLICE):
            sizes, prefix, salts, bits, prints = [], [], [], [], []
            for t, th in zip(texts(part), part.column("th").to_pylist(), strict=True):
                every = shingle_hashes(t, 5)
                h = np.unique(np.array(every, np.uint64))
                prints.append(every)
                n = len(h)
                first = h[np.lexsort((h, counts[_slot(h)]))[: n - math.ceil(threshold * n - 1e-9) + 1]]
                width = min(max(64, 1 << (4 * n - 1).bit_length() if n else 64), BITMAP)
                odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                sizes.append(n)
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
                if not n:
                    first = np.zeros(1, np.uint64)
                if th in done:
                    first = first[:0]
                prefix.append(first.view(np.int64))
                ways = counts[_slot(first)].astype(np.int64) // hot + 1
                salts.append(np.where(ways > 1, np.int64(th) % ways, -1))
                if len(done) < SENT:
                    done.add(th)
            keys = pa.StructArray.from_arrays([pa.array(np.concatenate(prefix)), pa.array(np.concatenate(salts).astype(np.int32))], names=["key", "salt"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), keys)
            columns = [part.column("doc_id"), part.column("th"), part.column("th2"), pa.array(fold(prints)), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "th2", "fp", "size", "prefix", "bits"])

    return run


_MET = "kind int, key long, th long, size long, members array<struct<th:long,size:long>>, sig long"


def _lists(batches):
    """Rows ``(key, salt, size, th)`` in this order to lists of texts that share a key.

    Kind 0 is a list of up to ``SHORT`` texts. A longer or salted one gives a row of kind 1 for each text, as it comes, and one of kind 2
    with the number of texts; nothing longer than ``SHORT`` is held. ``sig`` is equal for equal lists.
    """
    rows, key, held, sig, n, last, short = [], (None, -1), [], 0, 0, None, SHORT

    def close():
        if n > short:
            rows.append((2, key[0], None, n, None, sig))
        elif n > 1:
            rows.append((0, key[0], None, n, [{"th": t, "size": s} for t, s in held], sig))

    def pack():
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("th", pa.int64()), ("size", pa.int64())])), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "th", "size", "members", "sig"])

    for batch in batches:
        for k, salt, size, t in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "size", "th")), strict=True):
            if (k, salt) != key:
                close()
                key, held, sig, n, last = (k, salt), [], 0, 0, None
                short = SHORT if salt < 0 else 0
            if t == last:
                continue
            last, n = t, n + 1
            sig = (sig * 0x5851F42D4C957F2D + t + 0x14057B7EF767814F) & 0x7FFFFFFFFFFFFFFF
            if n <= short:
                held.append((t, size))
            if n == short + 1:
                rows += [(1, k, ht, hs, None, None) for ht, hs in held]
            if n > short:
                rows.append((1, k, t, size, None, None))
        if len(rows) > 2000:
            yield pack()
    close()
    if rows:
        yield pack()


def _shingles(batches):
    """The distinct 5-word shingles of each text, hashed and sorted."""
    for part in slices(batches, limit=SLICE):
        found = [_distinct_shingles(t).tobytes() for t in texts(part)]
        yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(found, pa.binary())], names=["th", "sh"])


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both)


def _similar(threshold: float):
    def run(batches):
        for batch in slices(batches, "sa", SLICE):
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                keep.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _open_pairs(size: np.ndarray, label: np.ndarray, bits: list[bytes], threshold: float):
    """Pairs of a block in different components whose sizes and bitmaps allow the similarity."""
    width = np.array([len(b) for b in bits])
    maps = {w: np.frombuffer(b"".join(b for b in bits if len(b) == w), np.uint64).reshape(-1, w // 8) for w in np.unique(width).tolist()}
    places = {w: np.flatnonzero(width == w) for w in maps}
    share = (1 - threshold) / (1 + threshold)
    for w, own in maps.items():
        for v, others in maps.items():
            if v < w:
                continue
            other = others
            while other.shape[1] > own.shape[1]:
                half = other.shape[1] // 2
                other = other[:, :half] ^ other[:, half:]
            for i, row in zip(places[w].tolist(), own, strict=True):
                j = places[v]
                ok = (label[j] != label[i]) & (np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9)
                at = np.flatnonzero(ok)
                apart = np.bitwise_count(other[at] ^ row).sum(axis=1, dtype=np.int64)
                for x in j[at[apart <= share * (size[j[at]] + size[i]) + 1e-9]].tolist():
                    yield i, x


def _list_pairs(threshold: float):
    """All pairs of a short list whose sizes allow the similarity."""

    def run(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column("members"):
                m = members.values
                th, size = m.field("th").to_numpy(), m.field("size").to_numpy()
                i, j = np.nonzero((th[:, None] > th[None, :]) & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9))
                a.append(th[i])
                b.append(th[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _apart(x: bytes, y: bytes) -> int:
    """Places in which two bitmaps differ, the wider one folded."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _may_be_similar(threshold: float):
    """Pairs that the bitmaps do not rule out."""

    def run(batches):
        share = (1 - threshold) / (1 + threshold)
        for batch in batches:
            bits = zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), batch.column("total").to_pylist(), strict=True)
            keep = [_apart(x, y) <= share * total + 1e-9 for x, y, total in bits]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _open_members(threshold: float):
    """The texts of a block that open pairs connect, as sorted lists."""

    def run(batches):
        for batch in batches:
            out = []
            for members in batch.column("members"):
                m = members.values
                th, size, label = (m.field(c).to_numpy() for c in ("th", "size", "label"))
                near = np.eye(len(th), dtype=bool)
                for i, j in _open_pairs(size, label, m.field("bits").to_pylist(), threshold):
                    near[i, j] = near[j, i] = True
                group = _labels(near)
                out += [np.unique(th[group == g]).tolist() for g in np.flatnonzero(np.bincount(group) > 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["ths"])

    return run


def _verified_stars(threshold: float):
    """Stars over the similar pairs of a block; pairs that are in one component already are not compared."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                m = members.values
                th, label = m.field("th").to_numpy(), m.field("label").to_numpy().copy()
                sh = [np.frombuffer(x, np.uint64) for x in m.field("sh").to_pylist()]
                for i in range(len(th)):
                    for j in range(i):
                        small, big = sorted((len(sh[i]), len(sh[j])))
                        if label[i] != label[j] and small >= threshold * big - 1e-9 and _alike(sh[i], sh[j], threshold):
                            label[label == label[i]] = label[j]
                            a.append(int(th[i]))
                            b.append(int(th[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def similar_groups(docs: DataFrame, threshold: float = 0.8, block: int = TEXT_BLOCK, radius: int = 3, hot: int = HOT) -> DataFrame:
    """``(doc_id, th, th2, keep_id)``: groups of equal texts and of texts whose 5-word shingles are similar.

    Candidates come from the covering tables of the texts' fingerprints, one star per linked group, and from a join on
    prefixes (see ``_sketch``), which misses no similar pair. Bitmaps, which rule out no similar pair, come first, then the
    exact Jaccard similarity of the shingles decides. Prefix rows are dealt by key and sorted once; a task streams over them.
    All pairs of a list of up to ``SHORT`` texts are compared. In longer lists texts are first compared with the
    smallest; what that leaves in different components is compared pair by pair in blocks of about ``block`` texts,
    which give a forest of verified links, never all pairs. A staged table is deleted after its last reader.

    ``th`` and ``th2`` are two hashes of the text, 128 bits together: a text that only shares ``th`` with another has its own
    id as ``keep_id``, the smallest doc_id of the group for all others.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(7), "text")})
    sent = docs.sparkSession.sparkContext.broadcast(slot_counts(keyed))
    held = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        held.append(stage(df, name))
        return held[-1]

    seen = kept(keyed.mapInArrow(_sketch(sent, threshold, hot), "doc_id long, th long, th2 long, fp long, size long, prefix array<struct<key:long,salt:int>>, bits binary"), "sketches")
    nodes = kept(seen.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th2")).alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size")).select("th", F.col("first.doc_id").alias("first_id"), F.col("first.th2").alias("th2"), "fp", "size"), "nodes")

    # links of the fingerprints, between the smallest texts that have them and from each text to that of its own
    own = kept(nodes.groupBy("fp").agg(F.min(F.struct("th", "size")).alias("low")), "prints")
    near = near_links(own, radius, stage=kept)
    lead = own.selectExpr("fp", "low.th t", "low.size s")
    near = near.join(lead.selectExpr("fp a", "t ta", "s sa"), "a").join(lead.selectExpr("fp b", "t tb", "s sb"), "b").selectExpr("ta a", "tb b", "sa", "sb")
    same = nodes.join(lead, "fp").where("th <> t").selectExpr("th a", "t b", "size sa", "s sb")
    stars = near.unionByName(same)

    rows = seen.select("th", "size", F.inline("prefix")).select("key", "salt", "size", "th")
    met = kept(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "th").mapInArrow(_lists, _MET), "lists")
    short = met.where("kind = 0").groupBy("sig", "size").agg(F.first("members").alias("members"))
    # long lists of the same texts are looked at once
    lists = met.where("kind = 2").groupBy("key").agg(F.sum("size").alias("n"), F.bit_xor("sig").alias("sig"))
    lists = lists.groupBy("sig", "n").agg(F.min("key").alias("key")).select("key", "n")
    long = kept(met.where("kind = 1").select("key", "th", "size").join(lists, "key"), "long")
    low = long.groupBy("key").agg(F.min(F.struct("size", "th")).alias("low"))
    stars = stars.unionByName(long.join(low, "key").selectExpr("th a", "low.th b", "size sa", "low.size sb").where("a <> b"))
    stars = stars.where(F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - 1e-9).select("a", "b")
    pairs = short.select("members").mapInArrow(_list_pairs(threshold), "a long, b long").unionByName(stars)
    pairs = kept(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")

    wanted = pairs.selectExpr("a th").unionByName(pairs.selectExpr("b th")).unionByName(long.select("th")).distinct()
    maps = kept(seen.select("th", "doc_id", "size", "bits").join(nodes.select("th", "first_id").join(wanted, "th"), "th").where("doc_id <=> first_id").select("th", "size", "bits", "first_id").dropDuplicates(["th"]), "maps")
    both = pairs.join(maps.selectExpr("th a", "size na", "bits xa"), "a").join(maps.selectExpr("th b", "size nb", "bits xb"), "b")
    pairs = kept(both.selectExpr("a", "b", "na + nb total", "xa", "xb").mapInArrow(_may_be_similar(threshold), "a long, b long"), "pairs")

    need = pairs.selectExpr("a t").unionByName(pairs.selectExpr("b t")).unionByName(long.selectExpr("th t")).distinct()
    one = maps.selectExpr("th t", "first_id").join(need, "t")
    shingles = keyed.join(one, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("th", "text")
    shingles = kept(shingles.mapInArrow(_shingles, "th long, sh binary").dropDuplicates(["th"]), "shingles")
    both = pairs.join(shingles.selectExpr("th a", "sh sa"), "a").join(shingles.selectExpr("th b", "sh sb"), "b")
    links = kept(both.mapInArrow(_similar(threshold), "a long, b long"), "links")

    labels = components(links).withColumnRenamed("node", "th")
    known = kept(shingles.select("th").join(labels, "th", "left").select("th", F.coalesce("label", "th").alias("label")), "labels")
    open_ = long.select("key", "th").join(known, "th").groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = long.join(open_, "key").join(known, "th").join(maps.select("th", "bits"), "th")
    total = long.groupBy("key").agg(F.sum("size").alias("total"))
    left = left.join(total, "key").withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("total") / BLOCK_SHINGLES)).cast("int"))
    left = left.withColumn("own", F.pmod(F.xxhash64("th"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    left = left.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.struct("th", "size", "label", "bits").alias("m"))
    blocks = left.groupBy("key", "p", "q").agg(F.collect_list("m").alias("members")).select("members").mapInArrow(_open_members(threshold), "ths array<long>")
    blocks = kept(blocks.dropDuplicates(["ths"]), "blocks").select(F.xxhash64("ths").alias("id"), F.explode("ths").alias("th"))
    full = blocks.join(known, "th").join(shingles, "th").groupBy("id").agg(F.collect_list(F.struct("th", "label", "sh")).alias("members"))
    more = full.select("members").mapInArrow(_verified_stars(threshold), "a long, b long")
    labels = components(links.unionByName(more)).withColumnRenamed("node", "th")
    linked = kept(nodes.select("th", "first_id").join(labels, "th"), "linked")
    lowest = linked.groupBy("label").agg(F.min("first_id").alias("low_id"))
    best = linked.join(lowest, "label").select("th", "low_id")
    ids = nodes.select("th", "th2", F.col("first_id")).join(best, "th", "left").select("th", F.col("th2").alias("_th2"), F.coalesce("low_id", "first_id").alias("keep_id"))
    out = seen.select("doc_id", "th", "th2").join(ids, "th")
    out = stage(out.select("doc_id", "th", "th2", F.when(F.col("th2") == F.col("_th2"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id")), "groups")
    unstage(held)
    return out


def drop_near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; columns as they are."""
    groups = similar_groups(docs, threshold).where("doc_id <> keep_id").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("th2").alias("_th2")).distinct()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = (docs["doc_id"].cast("long") == groups["_id"]) & (F.xxhash64(text) == groups["_th"]) & (F.xxhash64(F.lit(7), text) == groups["_th2"])
    return docs.join(groups, same, "left_anti")
