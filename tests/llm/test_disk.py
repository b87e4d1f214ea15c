"""What the join of near copies deals out: texts of pairs that may link, by sketches of their sets."""

from __future__ import annotations

import numpy as np
from test_operators import by_id, components_by_force

from tessella.llm import common, jaccard


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(11)
    apart = 0
    for size in (0, 1, 5, 63, 64, 65, 500, 3000, 70_000):
        for share in (0.0, 0.5, 0.9, 1.0):
            for other in (size, size * 5 // 4, size * 3):
                x = rng.choice(1 << 62, size, replace=False).astype(np.uint64)
                y = np.concatenate([x[: int(size * share)], rng.integers(1 << 62, 1 << 63, other).astype(np.uint64)])[: max(other, 1)]
                sets = [np.unique(s) for s in (x, y)]
                h = np.concatenate(sets)
                a, b = jaccard.sketches(np.stack([h, h]), np.array([0, len(sets[0]), len(h)]))
                least, true = jaccard.difference(a, b), len(np.setxor1d(*sets))
                assert least == jaccard.difference(b, a) <= true
                apart += size >= 64 and share == 0.0 and 9 * least > len(h)
    assert apart >= 12  # and most of those that share nothing are told apart
    assert jaccard.sketches(np.zeros((2, 0), np.uint64), np.zeros(1, np.int64)) == []


def test_texts_travel_only_for_pairs_that_may_link(spark, monkeypatch):
    """Documents that share a passage meet in regions of few; before, all their texts were packed and dealt out for each pair."""
    rng = np.random.default_rng(2)
    passage = [f"p{k}" for k in range(40)]
    texts = {k: " ".join([*passage, *(f"w{x}" for x in rng.integers(0, 1 << 30, 200))]) for k in range(1, 13)}
    texts[20] = texts[5] + " end"
    texts[21], texts[22], texts[23] = "a b c", "a b c", None
    written = {}

    def cut(df, name, like=None, old=common.cut):
        out = old(df, name, like)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    got = by_id(jaccard.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)), "n_shingles", "component_id")
    assert got == components_by_force(list(texts.items()))
    assert written["texts"] == [2]
