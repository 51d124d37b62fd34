"""Tokens, packing, personal data, language, suffix tree, HTML, decontamination and the pipeline against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from terralag.llm import decontaminate, html_text, langid, packing, pii, queries, simhash_dedup, suffix_tree, token_count
from terralag.llm.common import stage
from terralag.llm.tokens import PartCache, id_bytes

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "a  b", "a \n b", " lead", "trail ", "it's we'll", "x<|endoftext|>y <|endoftext|>", "é è　", "\x1c a", "😀 😀", "<|endoftext", "1 2  3"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(JSON)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed=3, size=40):
    rng = random.Random(seed)
    marks = [*"ab  \n\t'sé1.!<|>", "<|endoftext|>", "'ll", "  ", " x", "\x1c", "😀", " "]
    return ODD + ["".join(rng.choice(marks) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_parts_give_the_ids_of_the_whole_text(library, path):
    ts, cache = odd_texts(1500), PartCache(id_bytes(path), limit=30)
    for i in range(0, len(ts), 100):
        for t, v in zip(ts[i : i + 100], cache.look_up(ts[i : i + 100]), strict=True):
            assert np.frombuffer(b"".join(v), "<u4").tolist() == library(t), t


@pytest.mark.parametrize(("chunk", "overlap"), [(100, 80), (400, 100), (token_count.CHUNK, token_count.OVERLAP)])
def test_token_counts_of_chunks(spark, docs_of, library, chunk, overlap):
    rows = list(enumerate(odd_texts(60, size=900)))
    rows += [(900, None), (901, "y" * 5000), (902, " " * 3000 + "z"), (903, "<|endoftext|>" * 300), (900, None), (None, "a b")]
    got = token_count.token_counts(docs_of(rows), JSON, chunk, overlap).collect()
    want = sorted((str(i), len((t or "").encode()), len(library(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def test_token_counts_of_other_files(spark, docs_of):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(enumerate(["", "two words", None, "été 😀"]))
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs_of(rows), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in rows}
    assert token_count.token_counts(docs_of([]), JSON).count() == 0


def check_packing(rows, pieces, library, size):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.row), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    texts = sorted((str(i), tuple([*library(t), 0])) for i, t in rows)
    got = []
    for ps in by_doc.values():
        ps.sort(key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in ps)
        got.append((str(ps[0].doc_id), tuple(np.frombuffer(ids, "<u4").tolist())))
        assert [p.start for p in ps] == np.r_[0, np.cumsum([p.length for p in ps])[:-1]].tolist()
        assert all(p.doc_tokens == len(ids) // 4 and p.length == len(p.ids) // 4 > 0 for p in ps)
    assert sorted(got) == texts
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        used = sum(p.length for p in ps)
        assert [p.offset for p in ps] == np.r_[0, np.cumsum([p.length for p in ps])[:-1]].tolist()
        assert used == size or (used < size and used & (used - 1) == 0)


@pytest.mark.parametrize(("windows", "fan"), [(64, 256), (2, 2)])
def test_packing_round_trip(spark, docs_of, library, windows, fan):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["word", "other", "été"]) for _ in range(rng.choice([0, 3, 20, 90, 200])))) for i in range(120)]
    rows += [(500, None), (501, ""), (501, ""), (None, "x"), (502, "z " * 3000)]
    packed = packing.pack(docs_of(rows).repartition(7), RANKS, size=128, windows=windows, fan=fan).collect()
    check_packing(rows, packed, library, 128)
    assert packing.pack(docs_of([]), RANKS).count() == 0


def test_op10_and_op8_on_the_table(spark, data, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op8_token_counts"](spark, data).collect()}
    ids = {i: library(t) for i, t in docs.items()}
    assert counts == {i: (len(t.encode()), len(ids[i]), len(ids[i]) > 1024) for i, t in docs.items()}
    for p in queries.QUERIES["op10_packing"](spark, data).collect():
        own = [*ids[p.doc_id], 0][p.start : p.start + p.length]
        assert len(own) == p.length and zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            if low <= len(d) <= high and (kind == "phone" or luhn):
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for i in range(20000):
        t = "".join(rng.choice("aB@@..+-- 0123456789 ()é" if i % 3 else "0123 -.+") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == base_spans(t), t


def test_added_spans_and_linear_time():
    t = "pay http://joe:pw@host/ IBAN GB82 WEST 1234 5698 7654 32 ok, ssn: 123-45-6789, Account no. 12345678, mailto:x@localhost"
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "login"] == ["joe:pw@host", "x@localhost"]
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "account"] == ["GB82 WEST 1234 5698 7654 32", "123-45-6789", "12345678"]
    begun = time.time()
    pii.spans("a" * 300_000 + "@" + "1." * 50_000 + "1 " * 50_000 + "+1" * 50_000 + "9" * 300_000 + "@a" * 100_000)
    assert time.time() - begun < 20


def test_op4_on_the_table(spark, data, docs_of):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.QUERIES["op4_pii_anchors"](spark, data).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(map(str, s)) for s in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert set(x for x in r.spans.split(",") if x) >= {":".join(map(str, s)) for s in want}
    got = pii.digests(pii.personal_data(docs_of([(1, None), (2, ""), (None, "a@b.cd"), (3, "x"), (3, "x")]))).collect()
    assert sorted((str(r.doc_id), r.n_email, r.spans) for r in got) == [("1", 0, ""), ("2", 0, ""), ("3", 0, ""), ("3", 0, ""), ("None", 1, "email:0:6")]
    assert pii.personal_data(docs_of([])).count() == 0


def test_language_held_out_accuracy(spark, data):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.QUERIES["op6_language_id"](spark, data).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in lang}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"} for r in got)


def test_language_odd_inputs(spark, docs_of):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "123 !! 456"), (103, "Katze und Hund"), (103, "Katze und Hund"), (None, "the mat")]
    lang = ["en" if i % 2 else "de" for i in range(40)] + [None] * 6
    docs = docs_of(rows, lang)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert sorted(r.lang_pred for r in got[40:]) == ["de", "de", "en", "und", "und", "und"]
    assert langid.predict(docs_of([]), langid.fit(docs_of([]))).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs_of(rows, [None] * 46))).collect()} == {("und", 0.0)}


def test_document_frequencies_cover_all_rows(spark, docs_of):
    ts = [f"word{i % 7} common é" for i in range(50)] + [None, "12"]
    want = np.zeros(langid.BUCKETS + 1, int)
    for t in ts[:50]:
        want[np.unique(langid.grams(t))] += 1
        want[langid.BUCKETS] += 1
    assert (langid.document_frequencies(docs_of(list(enumerate(ts))).repartition(5)) == want).all()


def brute_base(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = c.total(), len(c)
    return sorted((str(i), held(i), len(w := words(t)), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows)


@pytest.mark.parametrize("share", [1e-6, 0.05])
def test_base_scores_against_brute_force(spark, docs_of, share):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", f"w{rng.randrange(60)}", "É"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(900, None), (901, " \t"), (901, " \t"), (None, "unseen the")]
    got = suffix_tree.language_model_scores(docs_of(rows), langid.held_out(7, 2), head_share=share).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert suffix_tree.language_model_scores(docs_of([]), langid.held_out(7, 2)).count() == 0


def test_suffix_tree_counts_and_probabilities(spark, docs_of):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abc", "b"]) for _ in range(rng.randint(0, 20)))) for i in range(60)]
    depth, docs = 3, docs_of(rows).repartition(3)
    seen = suffix_tree.string_counts(docs, depth, 0.0)
    data = [b"\n" * depth + " ".join(t.split()).encode() + b"\n" for _, t in rows]
    for k in range(depth + 1):
        want = Counter((int.from_bytes(s[i - k : i], "big"), s[i]) for s in data for i in range(depth, len(s)))
        part = seen.filter(pa_equal(seen, k))
        assert dict(zip(zip(part["context"].to_pylist(), part["symbol"].to_pylist(), strict=True), part["n"].to_pylist(), strict=True)) == dict(want)
    texts = [s[depth:] for s in data]
    totals = []
    for gain in (0.0, 2.0, math.inf):
        tree = suffix_tree.build(seen, depth, gain)
        every = np.arange(tree.width)
        for state in range(len(tree.link)):
            logs, _ = tree.step(np.full(tree.width, state, np.int32), every)
            assert (10.0**logs * np.r_[np.ones(tree.width - 1), 257 - (tree.width - 1)]).sum() == pytest.approx(1, abs=1e-5)
        assert np.allclose(suffix_tree.score_all(tree, texts, depth, segment=4), suffix_tree.score_all(tree, texts, depth, segment=512))
        totals.append(suffix_tree.score_all(tree, texts, depth).sum())
    assert len(tree.link) == 1 and totals == sorted(totals, reverse=True)


@pytest.mark.parametrize("gain", [0.0, 1.0, 6.0])
def test_states_are_the_longest_suffixes(spark, docs_of, gain):
    """States, smoothing and divergence against a recursion over plain dictionaries."""
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abc", "b", "cab"]) for _ in range(rng.randint(0, 25)))) for i in range(80)]
    depth, least = 4, 3
    tree = suffix_tree.build(suffix_tree.string_counts(docs_of(rows), depth, least), depth, gain)
    data = [b"\n" * depth + " ".join(t.split()).encode() + b"\n" for _, t in rows]
    count = Counter((s[i - k : i], s[i : i + 1]) for s in data for i in range(depth, len(s)) for k in range(depth + 1))
    total = Counter()
    for (c, _), n in count.items():
        total[c] += n
    symbols = [bytes([x]) for x in range(257 - 1)]

    def p(c, x):
        """The smoothed probability after a context that is looked at."""
        kinds = sum(1 for y in symbols if count[c, y] * 64 >= least)
        base = p(c[1:], x) if c else 1 / 257
        return (count[c, x] + kinds * base) / (total[c] + kinds)

    looked_at = [c for c in total if total[c] >= least]
    kept = {b""}
    for c in looked_at:
        if c and total[c] * sum(p(c, x) * math.log(p(c, x) / p(c[1:], x)) for x in symbols) + total[c] * p(c, b"\xff") * math.log(p(c, b"\xff") / p(c[1:], b"\xff")) >= gain:
            kept |= {c[i:] for i in range(len(c))}
    states = kept | {c[:i] for c in kept for i in range(len(c))}
    assert len(tree.link) == len(states)
    longest = lambda text, among: next(text[i:] for i in range(len(text) + 1) if text[i:] in among)
    names = {0: b""}
    for s in data:
        at, want = np.zeros(1, np.int32), 0.0
        for i in range(len(s)):
            logs, to = tree.step(at, tree.classes[[s[i]]])
            if i >= depth:
                want = math.log10(p(longest(s[max(0, i - depth) : i], kept), s[i : i + 1]))
                assert logs[0] == pytest.approx(want, abs=1e-5)
            at = to
            found = longest(s[max(0, i + 1 - depth) : i + 1], states)
            if i >= depth:
                assert names.setdefault(int(at[0]), found) == found


def pa_equal(table, k):
    import pyarrow.compute as pc

    return pc.equal(table["k"], k)


def test_long_contexts_help_on_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", langid.held_out(7, 2).alias("held"))
    texts = [b" ".join(suffix_tree.tokens(r.text)) + b"\n" for r in docs.where("held").collect()]
    score = []
    for depth in (0, 1, 3, 6):
        tree = suffix_tree.build(suffix_tree.string_counts(docs.where("not held"), depth), depth)
        score.append(suffix_tree.score_all(tree, texts, depth).sum())
    assert score == sorted(score)
    got = {r.doc_id: r.score for r in queries.QUERIES["op3_suffix_tree_scores"](spark, data).collect() if r.held_out}
    assert np.isclose(sum(got.values()), score[-1], rtol=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><ul><li>a<li>b<ol start=3><li>x</li><li>y</ol></li></ul>
<h1>Head &amp; <b>er</b></h1><p>one<p>two<br>three <i hidden>no</i><i style="display: none">no</i>
<table><tr><th>A<th>Bee<tr><td>long cell<td>2</table><pre> x
   y</pre> tail < 5 <!-- c --><div>q</div>z<script>var x="</p>"</script><p style='visibility:hidden'>nn</p>end"""


def test_packing_of_a_long_text():
    packer, n = packing.Packer(1024, 4, 0), 4_000_000
    begin = time.time()
    packer.place((1, 0, 0, n, bytes(4 * n)))
    assert time.time() - begin < 1 and len(packer.out) == n // 1024 and packer.open[0][0] == n % 1024


def test_html_layout():
    want = "  - a\n  - b\n    3. x\n    4. y\n\nHead & er\n\none\n\ntwo\nthree\n\nA          Bee\nlong cell  2\n\n x\n   y\n\ntail < 5\nq\nz\n\nend"
    assert html_text.visible_text(PAGE) == want


def test_html_cells_keep_blocks_lists_and_spans():
    v = html_text.visible_text
    assert v("<table><tr><td><h1>T</h1><p>one<p>two<ul><li>a<li>b</ul></table>") == "T\n\none\n\ntwo\n\n  - a\n  - b"
    assert v("<table><tr><td><p>one<p>two<td><ul><li>a<li>b</ul></table>tail") == "one    - a\n       - b\ntwo\n\ntail"
    assert v("<table><tr><td>menu<td><h1>Title</h1><p>" + "wide text " * 6 + "<p>second</table>") == "menu\n\nTitle\n\n" + ("wide text " * 6).strip() + "\n\nsecond"
    assert v("<table><tr><th colspan=2>Head<th>x<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>1<td>2<td>3</table>") == "Head  x\na  b  c\n   d  e\n1  2  3"
    assert v("<table><tr><td colspan=x>a<td colspan=0 rowspan=-1>b</table>") == "a  b"


def test_html_names_hidden_by_styles_and_labels():
    page = "<style>.x, #y { color: red; display:none } @media print { .z{display:none} .w{display:none} } .v .u{display:none}</style><style>.t{visibility:hidden"
    page += "</style><p class='a x'>no<p id=y>no<p class='z w v u t'>yes <input type=submit value=Go> <input value=typed> <img alt='a cat'> <img>"
    assert html_text.visible_text(page) == "yes Go a cat"


@pytest.mark.parametrize("page", ["<li><table>" + "<b>" * 20_000 + "</li>" * 20_000, "<table>" + "<tr><td rowspan=1000>x" * 20_000, "<table><tr>" + "<td colspan=1000>x" * 20_000, "<style>" * 20_000, "<style>{" * 20_000])
def test_html_time_grows_with_the_page(page):
    begin = time.time()
    html_text.visible_text(page)
    assert time.time() - begin < 8


def test_html_keeps_all_visible_words(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = r.html[r.html.index("<body>") :]
        plain = re.sub(r"<!--.*?-->|<script.*?</script>|<[^>]*>", " ", body, flags=re.S)
        plain = plain.replace("&amp;", "&").replace("&copy;", "©").replace("&middot;", "·").replace("&quot;", '"')
        words = lambda t: [w for w in re.findall(r"\w+", t)]
        assert words(html_text.visible_text(r.html)) == words(plain)


@pytest.mark.parametrize("page", ["<b>" * 20000 + "</i>" * 20000, "<a \"" * 20000, "<!--" * 20000, "<li>" * 20000, "<ul><li>" * 5000, "<table><tr><td>" * 800 + "x", "<script>" * 5000, "<", "</", "&#x110000;&amp", "a" * 100000])
def test_html_hard_pages_end_soon(page):
    begun = time.time()
    html_text.visible_text(page)
    assert time.time() - begun < 15


def test_html_rows(spark):
    rows = [(1, "<p>a", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "<p>a", 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text int")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "a"), ("1", "a"), ("2", ""), ("3", ""), ("None", "x")]


def brute_matches(docs, items, width=5, threshold=0.8):
    out, bags = {}, []
    for i, t in items:
        w = decontaminate.words_of(t or "")
        if w:
            k = min(width, len(w))
            bags.append((i, k, len(w) - k + 1, Counter(b" ".join(w[j : j + k]) for j in range(len(w) - k + 1))))
    for d, t in docs:
        w = decontaminate.words_of(t or "")
        for i, k, m, bag in bags:
            s = [b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)]
            best = max((decontaminate.similarity(bag, Counter(s[p : p + m])) for p in range(len(s) - m + 1) if s[p] in bag or s[p + m // 2] in bag), default=0)
            if best >= threshold:
                out[d, i] = round(max(best, out.get((d, i), 0)), 9)
    return out


def test_decontamination_against_brute_force(spark, docs_of, data, monkeypatch):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()][:25]
    docs = []
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect():
        w = r.text.split(" ")[:300]
        if rng.random() < 0.5:
            passage = rng.choice(items)[1].upper().split(" ")
            for _ in range(rng.randint(0, 2)):
                passage[rng.choice([0, 1, -1, -2, len(passage) // 2])] = "edited"
            at = rng.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        docs.append((r.doc_id, " ".join(w)))
    items += [(900, None), (901, ""), (902, "exactly three words"), (903, items[0][1])]
    docs += [(9000, None), (9001, ""), (9002, "here are exactly  three WORDS in it"), (9003, "three words")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = brute_matches(docs, items)
    assert any(v < 1 for v in want.values()) and (9002, 902) in want
    for block in (10_000, 5):
        monkeypatch.setattr(decontaminate, "ITEM_BLOCK", block)
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs_of(docs), bench).collect()}
        assert got == want
    kept = decontaminate.drop_contaminated(docs_of(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})
    assert decontaminate.contaminated(docs_of([]), bench).count() == 0
    assert decontaminate.contaminated(docs_of(docs), bench.limit(0)).count() == 0


def test_documents_shorter_than_an_item(spark, docs_of):
    """The whole document is the window: items less some words, compared with all items."""
    rng = random.Random(13)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([60, 60, 61, 12, 9, 7, 30])]
    docs = []
    for i, t in items:
        w = t.split(" ")
        for cut in range(1, min(len(w) - 1, 14)):
            docs += [(100 * i + cut, " ".join(w[cut:])), (1000 + 100 * i + cut, " ".join(w[: len(w) - cut])), (2000 + 100 * i + cut, " ".join(w[cut // 2 : len(w) - (cut - cut // 2)]))]
        docs.append((3000 + i, " ".join([*w[1 : len(w) // 2], "edited", *w[len(w) // 2 + 1 :]])))
    want = {}
    for d, t in docs:
        w = t.split(" ")
        for i, u in items:
            bags = [Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4)) for x in (w, u.split(" "))]
            if (s := decontaminate.similarity(*bags)) >= 0.8:
                want[d, i] = (round(s, 9), len(w))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.n_words) for r in decontaminate.contaminated(docs_of(docs), bench).collect()}
    assert got == want and (6, 0) in want


def test_byte_tables_find_all_within_the_radius():
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"w{rng.integers(500)}" for _ in range(30))) for i in range(40)]
    index = decontaminate.Index(items, 5, 0.8, decontaminate.RADIUS)
    box = index.sizes[5, 26]
    prints = np.array([int(p) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 26), replace=False)) for p in box["prints"] for _ in range(20)], np.uint64)
    w, i, _ = index.lookup(box, prints)
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == {(a, b) for a in range(len(prints)) for b in range(40) if (int(prints[a]) ^ int(box["prints"][b])).bit_count() <= decontaminate.RADIUS}


def test_pipeline_stages(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, data), name)
        old = {r.doc_id: r.text for r in before.collect()}
        if name == "packing":
            ids = {i: [*library(t), 0] for i, t in old.items()}
            got = docs.collect()
            assert sum(p.length for p in got) == sum(map(len, ids.values()))
            assert all(zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in got)
            break
        assert docs.columns == before.columns
        new = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert {i for i, t in old.items() if langid.has_letter(t)} == set(new)
        elif name == "simhash_near_dedup":
            shingles = {i: set(simhash_dedup.shingle_hashes(t, 5)) for i, t in old.items()}
            alike = lambda a, b: old[a] == old[b] or len(shingles[a] & shingles[b]) >= 0.8 * max(1, len(shingles[a] | shingles[b]))
            assert all(any(j < i and alike(i, j) for j in old) for i in old if i not in new)
            assert not any(alike(i, j) for i in new for j in new if j < i)
        elif name == "benchmark_decontamination":
            assert set(old) - set(new) == {d for d, _ in brute_matches(old.items(), bench)}
        else:
            assert set(old) == set(new)


def test_stages_keep_columns_that_clash(spark, data):
    """Extra columns named like the operators' own pass through every stage unchanged."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    own = ["bitmap", "score", "lang_pred", "th", "fp", "a", "b", "node", "label", "keep_id", "pos", "row", "item_id"]
    docs = docs.selectExpr("*", *[f"doc_id * 2 AS {c}" for c in own])
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, data), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == 2 * r.doc_id for r in out.collect() for c in own)
            docs = out
    assert out.count()


def test_pipeline_of_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, data), name)
        assert docs.count() == 0
