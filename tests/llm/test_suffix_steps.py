"""A step of the automaton touches the links of those symbols only that were not seen after their state."""

import numpy as np

from terralag.llm import suffix_tree


def test_steps_follow_the_links(spark):
    texts = ["the cat sat on the mat", "the dog ate the cat food", "a bird sang é"] * 40
    seen = suffix_tree.string_counts(spark.createDataFrame([(t,) for t in texts], "text string"), 4, 2)
    tree = suffix_tree.build(seen, 4, 0.5)
    state, symbol = (x.ravel() for x in np.meshgrid(np.arange(len(tree.link), dtype=np.int32), np.arange(tree.width)))
    got, to = tree.step_in(tree.cells(), state, (symbol >> 6).astype(np.uint8), (symbol & 63).astype(np.uint8))
    assert np.array_equal(got, tree.step(state, symbol)[0])
    for s, c, value, move in zip(state.tolist(), symbol.tolist(), got, to, strict=True):
        total = 0.0
        while not int(tree.bits[s, c >> 6]) >> (c & 63) & 1:
            total, s = total + tree.weight[s], int(tree.link[s])
        place = int(tree.first[s, c >> 6]) + (int(tree.bits[s, c >> 6]) & ((1 << (c & 63)) - 1)).bit_count()
        assert value == total + float(tree.logp[place]) and move == tree.move[place]
