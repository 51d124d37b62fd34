"""Manifest, proofs and roots against trees built in plain Python."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from terralag.llm import merkle

H = lambda *xs: sha256("".join(xs).encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root, and for each leaf its siblings (before, after) level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i - i % arity
            proofs[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], proofs


def plain_leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def plain_manifest(rows, arity, change):
    named = {}
    for r in rows:
        named.setdefault(r[1], []).append(r)
    trees = []
    for source in sorted(named, key=lambda s: (s is not None, (s or "").encode())):
        members = sorted(named[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((members, *plain_tree([plain_leaf(r) for r in members], arity)))
    root, above = plain_tree([t[1] for t in trees], arity)
    out = []
    for (members, subroot, proofs), more in zip(trees, above, strict=True):
        for r, proof in zip(members, proofs, strict=True):
            folded = plain_leaf(change(r))
            for before, after in proof + more:
                folded = H(before, folded, after)
            out.append((r[0], plain_leaf(r), subroot, root, H("".join(b + a for b, a in proof + more)), folded))
    return sorted(out, key=str)


def rows_of(n):
    text = lambda i: None if i % 11 == 5 else "é\nx" * (i % 4)
    rows = [(i, None if i % 7 == 3 else f"s{i % 5 % 3}", "en" if i % 2 else None, i if i % 3 else None, text(i)) for i in range(n)]
    rows += [(3, "s0", None, None, "twice"), (3, "s0", None, None, "twice"), (None, "s1", "", 0, ""), (90, "Z", "en", 1, "alone"), (91, "", "en", 1, "no name"), (92, "é", "de", 2, "\n" * 9)]
    return rows


def spark_manifest(spark, rows, arity):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, h int")
    changed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(table, arity, {"text": changed})
    text = merkle.hex_text
    found = found.select("doc_id", text(F.col("leaf")), text(F.col("subroot")), text(F.col("root")), F.sha2(merkle.proof_text(F.col("steps")), 256), merkle.fold(text(F.col("other")), F.col("steps")))
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize(("n", "arity"), [(70, 3), (23, 2), (40, 5)])
def test_manifest_equals_the_plain_trees(spark, n, arity):
    rows = rows_of(n)
    change = lambda r: (*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 == 0 and r[4] else r
    got = spark_manifest(spark, rows, arity)
    assert got == plain_manifest(rows, arity, change)
    assert any(r[5] != r[3] for r in got) and any(r[5] == r[3] for r in got)


def test_lone_leaves_are_roots(spark):
    one = (5, "s", "en", 1, "a\nb")
    [(doc, leaf, subroot, root, proof, folded)] = spark_manifest(spark, [one], 3)
    assert (doc, leaf, proof, folded) == (5, plain_leaf(one), H(""), root) and leaf == subroot == root
    assert spark_manifest(spark, [], 3) == []
