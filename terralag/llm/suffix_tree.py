"""Probabilistic suffix tree over the bytes of token sequences, beside a smoothed unigram base.

A text is lower-cased (A-Z) and cut at blanks. Its sequence is its words joined by one blank and an end
byte; blank and end occur in no word, so the tree's probability of the bytes is that of the tokens.

Training counts all byte strings of ``depth + 1`` in all training texts (pre-aggregated in each task),
and every shorter one follows from them. A context is looked at when it occurs ``least`` times and its symbols when
they occur ``least / 64`` times; ``least`` is the same count for any amount of text, so at ``LEAST`` no symbol of a context is
left out and more text gives more contexts. A context is kept when the
divergence of its distribution from its parent's (the context without its first byte), times its count, reaches
``gain`` nats, and so are its suffixes. Distributions are smoothed by the parent's with the weight of the
number of symbols seen (Witten-Bell), the root's by the uniform distribution over 257 symbols.

A state holds only the symbols seen after it, in arrays sorted by state, with a bitmap of its symbols; for any other symbol
it has a weight and a link to its longest proper suffix, which is asked instead. So the model that every task loads takes
a few bytes per string that passed the counts. Its states are the kept contexts and their prefixes, the next state
is the longest suffix that is a state. Texts are cut into segments that are run side by side, a bounded number at once; each
is led in by the ``depth`` bytes before it, which fix the state.

The base needs every token's count. Tokens that make up at least ``head_share`` of all (so at most
``1 / head_share``) are broadcast; the others are joined by token, where no key is frequent.

Defined cases: null, empty and blank texts are one end token; repeated rows are counted and scored one by
one; a null doc_id is held out; without training rows N = V = 0 and the tree is uniform; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralag.llm.common import slices, stage, texts, union_all, unstage

DEPTH, GAIN, HEAD_SHARE = 6, 8.0, 1e-6
#: How often a context has to occur to be looked at, however long the text is.
LEAST = 8
END, SEGMENT, FLUSH = 10, 1024, 300_000
#: Segments run at once; places counted at once; strings a task holds before it sends them; entries set at once.
GROUP, WINDOW, HELD, ENTRIES = 2048, 1 << 20, 1_000_000, 1 << 18
END_TOKEN = "\n"
_SYMBOLS = 257


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _merged(parts):
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
    return codes[starts], np.add.reduceat(counts, starts)


def _strings(depth: int):
    """Counts of byte strings of ``depth + 1``, packed into longs, last byte lowest."""
    lead = bytes([END]) * depth

    def run(batches):
        held, size = [], 0
        for part in slices(batches):
            sequences = [lead + b" ".join(tokens(t)) + b"\n" for t in texts(part)]
            data = np.frombuffer(b"".join(sequences), np.uint8)
            # a string whose last byte is in a text's lead is none of that text
            inside = np.ones(len(data), bool)
            begins = np.cumsum([0, *map(len, sequences[:-1])])
            inside[(begins[:, None] + np.arange(depth)).ravel()] = False
            for a in range(depth, len(data), WINDOW):
                b = min(a + WINDOW, len(data))
                code = np.zeros(b - a, np.int64)
                for i in range(depth, -1, -1):
                    code <<= 8
                    code |= data[a - i : b - i]
                first = np.sort(code[inside[a:b]])
                starts = np.flatnonzero(np.r_[True, np.diff(first) != 0]) if len(first) else np.zeros(0, np.int64)
                held.append((first[starts], np.diff(np.r_[starts, len(first)])))
                size += len(starts)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield _pairs(*held[0])
                        held, size = [], 0
        if size:
            yield _pairs(*_merged(held))

    return run


def _pairs(codes, counts):
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "n"])


def string_counts(train: DataFrame, depth: int, least: float = LEAST):
    """``(k, context, symbol, n)`` of the contexts of length k that occur ``least`` times, in narrow types, as they are collected."""
    code = stage(train.select("text").mapInArrow(_strings(depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "strings")
    out = []
    for k in range(depth, -1, -1):
        table = code.withColumn("code", F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).groupBy("code").agg(F.sum("n").alias("n"))
        table = table.withColumn("context", F.shiftrightunsigned("code", 8)).withColumn("symbol", F.col("code").bitwiseAND(F.lit(255)).cast("short"))
        often = table.groupBy("context").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("context")
        seen = table.join(often, "context").where(F.col("n") * 64 >= least)
        out.append(seen.select(F.lit(k).cast("byte").alias("k"), "context", "symbol", "n"))
    found = union_all(out).toArrow()
    unstage([code])
    return found


class Tree:
    """States with the symbols seen after them; any other symbol goes to the link with the state's weight.

    ``bits`` and ``first`` are, for each state and 64 symbols, a bitmap of the entries and the place before the first of
    them; ``logp`` and ``move`` are the entries, log10 probabilities and next states.
    """

    def __init__(self, classes, bits, first, logp, move, link, weight):
        self.classes, self.bits, self.first, self.logp, self.move, self.link, self.weight = classes, bits, first, logp, move, link, weight

    @property
    def width(self) -> int:
        """The symbols told apart; the last one stands for all others."""
        return int(self.classes.max()) + 1

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps in a row, and for each the place behind its last entry."""
        return self.bits.ravel(), self.first.ravel() + np.bitwise_count(self.bits.ravel()).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of symbols after states, and the next states."""
        return self.step_in(self.cells(), state, (symbol >> 6).astype(np.uint8), (symbol & 63).astype(np.uint8))

    def step_in(self, cells, state: np.ndarray, word: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`step` with :meth:`cells` at hand, for symbols given by their bitmap and the bit in it."""
        (bits, last), words = cells, self.bits.shape[1]
        cell = state * np.int64(words) + word
        above = bits.take(cell) >> bit
        place = last.take(cell) - np.bitwise_count(above)
        # most symbols were seen after their state; the places of the others are set below
        out = self.logp.take(place, mode="clip").astype(np.float64)
        to = self.move.take(place, mode="clip")
        open_ = np.flatnonzero((above & np.uint64(1)) == 0)
        at, word, bit, gained = state.take(open_), word.take(open_), bit.take(open_), np.zeros(len(open_))
        while len(open_):
            gained += self.weight.take(at)
            at = self.link.take(at)
            cell = at * np.int64(words) + word
            above = bits.take(cell) >> bit
            seen = (above & np.uint64(1)) != 0
            hit = np.flatnonzero(seen)
            place = last.take(cell.take(hit)) - np.bitwise_count(above.take(hit))
            here = open_.take(hit)
            out[here] = gained.take(hit) + self.logp.take(place)
            to[here] = self.move.take(place)
            miss = np.flatnonzero(~seen)
            open_, at, word, bit, gained = (x.take(miss) for x in (open_, at, word, bit, gained))
        return out, to


def _parent(context, k):
    return context & ((1 << 8 * (k - 1)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of values that are all there, in sorted keys."""
    return np.searchsorted(keys, wanted)


def _levels(seen, depth: int, gain: float):
    """For each length the contexts, their weight for unseen symbols, whether they are kept, and their entries."""
    used, levels = None, []
    for k in range(depth + 1):
        here = seen.filter(pc.equal(seen["k"], k))
        string = (here["context"].to_numpy() << 8) | here["symbol"].to_numpy()  # in order of context, then symbol
        order = np.argsort(string)
        string, count = string[order], here["n"].to_numpy()[order].astype(np.float64)
        del here, order
        if not k:
            used = string.copy()
        sym = _find(used, string & 255).astype(np.int16)
        string >>= 8
        fresh = np.diff(string, prepend=-1) != 0
        own, row = string[fresh], np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        begin = np.flatnonzero(fresh)
        del string, fresh
        if not k and not len(own):
            own = np.zeros(1, np.int64)
        if k:
            up = _find(levels[-1]["own"], _parent(own, k))
            key = levels[-1]["row"] * np.int64(256) + levels[-1]["sym"]
        else:
            up = np.zeros(len(own), np.int64)
        p, weight, keep = np.zeros(len(row)), np.ones(len(own)), np.ones(len(own), bool)
        # whole contexts, some entries at once
        cuts = np.unique(np.r_[np.searchsorted(begin, np.arange(0, len(row), ENTRIES)), len(begin)]).tolist()
        for c, d in zip(cuts, cuts[1:]):
            e = slice(begin[c], begin[d] if d < len(begin) else len(row))
            at, symbols, many = row[e] - c, sym[e], count[e]
            total, kinds = np.bincount(at, many, d - c), np.bincount(at, minlength=d - c).astype(np.float64)
            # a symbol seen here is seen after every suffix
            base = levels[-1]["p"][_find(key, up[c:d][at] * np.int64(256) + symbols)] if k else np.full(len(at), 1 / _SYMBOLS)
            unseen = kinds / (total + kinds)
            p[e] = here = (many + kinds[at] * base) / (total + kinds)[at]
            rest = np.maximum(1.0 - np.bincount(at, base, d - c), 0.0)
            weight[c:d] = unseen
            if k:
                keep[c:d] = total * (np.bincount(at, here * np.log(here / base), d - c) + rest * unseen * np.log(unseen)) >= gain
        del count, begin
        levels.append({"own": own, "up": up, "weight": weight, "kept": keep, "row": row, "sym": sym, "p": p})
    return used, levels


def build(seen, depth: int, gain: float = GAIN) -> Tree:
    """The automaton of ``string_counts`` rows; local, one length at a time."""
    used, levels = _levels(seen, depth, gain)
    del seen
    for k in range(depth, 1, -1):  # suffixes of what is kept
        levels[k - 1]["kept"][levels[k]["up"][levels[k]["kept"]]] = True
    state = [x["kept"].copy() for x in levels]
    for k in range(depth, 1, -1):  # and prefixes, as states only
        state[k - 1][_find(levels[k - 1]["own"], levels[k]["own"][state[k]] >> 8)] = True
    first = np.cumsum([0, *(int(x.sum()) for x in state)])
    number = [np.where(x, f + np.cumsum(x) - 1, -1).astype(np.int32) for x, f in zip(state, first[:-1], strict=True)]
    size, width = int(first[-1]), len(used) + 1  # the last symbol stands for all others
    words = -(-width // 64)
    classes = np.full(256, width - 1, np.int32)
    classes[used] = np.arange(len(used))
    bits, starts = np.zeros((size, words), np.uint64), np.zeros((size, words), np.int32)
    link, weight = np.zeros(size, np.int32), np.zeros(size)
    logp, move = np.zeros(0, np.float32), np.zeros(0, np.int32)
    for k, level in enumerate(levels):
        # entries: what was seen after a kept context, and what leads on from a prefix
        own, row, sym, p = level["own"], level.pop("row"), level.pop("sym"), level.pop("p")
        child = np.full(len(row), -1, np.int32)
        if k < depth:
            below = levels[k + 1]["own"]
            if len(below):
                string = (own[row] << 8) | used[sym]
                place = np.minimum(_find(below, string), len(below) - 1)
                child = np.where(below[place] == string, number[k + 1][place], -1)
        use = state[k][row] & (level["kept"][row] | (child >= 0))
        row, sym, child, p = row[use], sym[use], child[use], p[use]
        if not k:  # the root knows every symbol; the others share one entry
            rest = max(1.0 - float(p.sum()), 0.0) / max(_SYMBOLS - len(used), 1)
            row, sym, child, p = np.r_[row, 0], np.r_[sym, width - 1], np.r_[child, -1], np.r_[p, max(rest, 1e-300)]
        at = number[k][row]
        if k:
            states = np.flatnonzero(state[k])
            link[number[k][states]] = number[k - 1][level["up"][states]]
            weight[number[k][states]] = np.where(level["kept"][states], np.log10(level["weight"][states]), 0.0)
            tree = Tree(classes, bits, starts, logp, move, link, weight)
            cells, value, to = tree.cells(), np.zeros(len(at), np.float32), np.zeros(len(at), np.int32)
            for a in range(0, len(at), ENTRIES):
                cut = slice(a, a + ENTRIES)
                from_link, to_link = tree.step_in(cells, link[at[cut]], (sym[cut] >> 6).astype(np.uint8), (sym[cut] & 63).astype(np.uint8))
                value[cut] = np.where(level["kept"][row[cut]], np.log10(p[cut]), from_link)
                to[cut] = np.where(child[cut] >= 0, child[cut], to_link)
        else:
            value, to = np.log10(p), np.maximum(child, 0)
        np.bitwise_or.at(bits, (at, sym >> 6), np.uint64(1) << (sym & 63).astype(np.uint64))
        cell = at * np.int64(words) + (sym >> 6)
        inner = np.bincount(cell, minlength=size * words)
        counted = len(logp) + np.cumsum(inner) - inner
        touched = np.flatnonzero(inner)
        starts.ravel()[touched] = counted[touched]
        logp, move = np.r_[logp, value.astype(np.float32)], np.r_[move, to.astype(np.int32)]
    return Tree(classes, bits, starts, logp, move, link, weight)


def score_all(tree: Tree, sequences: list[bytes], depth: int, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each sequence; each ends with the end byte."""
    out, lead = np.zeros(len(sequences)), bytes([END]) * depth
    pieces, owners, cells = [], [], tree.cells()
    words, places = (tree.classes >> 6).astype(np.uint8), (tree.classes & 63).astype(np.uint8)

    def flush():
        if not pieces:
            return
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order])
        rows = np.zeros((len(order), int(sizes[0])), np.uint8)
        for at, i in enumerate(order):
            rows[at, : sizes[at]] = np.frombuffer(pieces[i], np.uint8)
        rows = np.ascontiguousarray(rows.T)
        word, bit = words[rows], places[rows]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order))
        for t in range(len(rows)):
            live = int(np.searchsorted(-sizes, -t))  # the longer ones come first
            gained, state[:live] = tree.step_in(cells, state[:live], word[t, :live], bit[t, :live])
            if t >= depth:
                total[:live] += gained
        np.add.at(out, [owners[i] for i in order], total)
        pieces.clear()
        owners.clear()

    for i, s in enumerate(sequences):
        for a in range(0, len(s), segment):
            pieces.append(lead + s[:segment] if not a else (lead + s[max(a - depth, 0) : a])[-depth:] + s[a : a + segment] if depth else s[a : a + segment])
            owners.append(i)
            if len(pieces) == GROUP:
                flush()
    flush()
    return out


def token_frequencies(train: DataFrame) -> DataFrame:
    """``(token, c)`` over all training texts; the end token is a line feed, which no word holds."""

    def run(batches):
        seen = Counter()
        for part in slices(batches):
            for t in texts(part):
                seen.update(tokens(t))
                seen[b"\n"] += 1
            if len(seen) > FLUSH:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return train.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _counted(seen):
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])


_ROW = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, score double, token string, n long"


def _score(sent, depth: int):
    """For each text one row of what is known here and a row for each token that is not frequent."""
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        tree, head = Tree(**sent.value[0]), sent.value[1]
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            split = [tokens(t) for t in texts(part)]
            scores = score_all(tree, [b" ".join(w) + b"\n" for w in split], depth)
            out, rare, rows_of, counts = [], [], [], []
            for d, h, w, s in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), split, scores, strict=True):
                found = [head.get(x) for x in (*w, b"\n")]
                logs = [x for x in found if x is not None]
                out.append((row, d, h, len(found), len(logs), math.fsum(logs), float(s), f"\n{row}", None))
                if len(logs) < len(found):
                    other = Counter(x for x, y in zip((*w, b"\n"), found, strict=True) if y is None)
                    rare += other
                    counts += other.values()
                    rows_of += [row] * len(other)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()), strict=True)], names=names)
            if rare:
                none = [pa.nulls(len(rare), k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(rows_of, pa.int64()), *none, pa.array(rare, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=names)

    return run


def language_model_scores(docs: DataFrame, held_out, depth: int = DEPTH, least: float = LEAST, gain: float = GAIN, head_share: float = HEAD_SHARE) -> DataFrame:
    """Every text of ``docs`` scored by models of the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    train = docs.where(~F.col("held_out"))
    vocabulary = stage(token_frequencies(train), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = vocabulary.where(F.col("c") >= size.n * head_share).toArrow()
    frequent = dict(zip((t.encode() for t in head["token"].to_pylist()), np.log10(head["c"].to_numpy() + 1.0).tolist(), strict=True))
    tree = build(string_counts(train, depth, least), depth, gain)
    sent = docs.sparkSession.sparkContext.broadcast((vars(tree), frequent))
    rows = stage(docs.mapInArrow(_score(sent, depth), _ROW), "scored")
    sent.destroy()  # workers that live on let go of the model
    met = rows.join(vocabulary, "token", "left")
    low = math.log10(size.n + size.v + 1)
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_head") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).cast("long").alias("n_known"),
        F.lit(size.n).cast("long").alias("train_tokens"),
        (F.max("head_log") + F.coalesce(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)), F.lit(0.0)) - F.max("n_tokens") * F.lit(low)).alias("base_score"),
        F.max("score").alias("score"),
    )
    return out.drop("row")
