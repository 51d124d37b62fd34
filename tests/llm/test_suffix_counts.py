"""Contexts are looked at from the same count on, however long the text is."""

from terralag.llm import suffix_tree


def test_long_texts_hide_no_context(spark):
    rare = "a " + "qzx " * suffix_tree.LEAST  # 8 times in some 6 million places
    docs = spark.range(0, 600, 1, 8).selectExpr(f"if(id = 5, '{rare}', repeat('the cat sat ', 850)) AS text")
    seen = suffix_tree.string_counts(docs, 3)
    found = {(r["k"], r["context"], r["symbol"]): r["n"] for r in seen.to_pylist()}
    number = lambda s: int.from_bytes(s, "big")
    assert found[2, number(b"qz"), ord("x")] == found[3, number(b" qz"), ord("x")] == suffix_tree.LEAST
    tree = suffix_tree.build(seen, 3)
    rare_text, other = suffix_tree.score_all(tree, [b"qzx qzx qzx\n", b"qzc qzc qzc\n"], 3)
    assert rare_text > other + 6
