"""Crowded regions of the join of near copies: what sketches tell apart does not go on, and no link is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from test_operators import by_id, components_by_force

from tessella.llm import common, jaccard


@pytest.mark.parametrize("parts", [1, 2])
def test_sifted_regions_lose_no_link(parts):
    rng = np.random.default_rng(5)
    word = lambda n: rng.choice(1 << 62, n, replace=False).astype(np.uint64)
    sets = [np.unique(word(size)) for size in (1, 5, 63, 64, 65, 80, 81, 500, 70_000, 66_000) for _ in range(3)]
    for many, size in ((2, 64), (5, 70), (17, 130), (40, 250), (330, 90)):
        core = word(size)
        sets += [np.unique(np.concatenate([core[: size - k % 7], word(k % 9)])) for k in range(many)]
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    h = np.concatenate(sets)
    drawn = jaccard.sketches(np.stack([h, h]), start)
    rows = [(region, doc) for region in (7, -3) for doc in range(len(sets)) if region == 7 or doc % 3]
    own = {doc: int(rng.integers(parts)) for doc in range(len(sets))}
    pairs, dense = set(), set()
    for i in range(parts):
        for j in range(i, parts):
            some = [(r, d) for r, d in rows if own[d] in (i, j)]
            task = {"region": [r for r, _ in some], "id": [d for _, d in some], "n": [len(sets[d]) for _, d in some], "own": [own[d] for _, d in some], "sketch": [drawn[d] for _, d in some], "i": [i] * len(some), "j": [j] * len(some)}
            for a, b, n, crowded in zip(*jaccard.sift_regions(pa.table(task)).to_pydict().values(), strict=True):
                assert a < b or crowded
                assert not crowded or n == len(sets[b])
                (dense if crowded else pairs).add((a, b))
    assert len(pairs) < (2 * jaccard.REGION * parts * len(rows))
    kept = 0
    for region in (7, -3):
        docs = [d for r, d in rows if r == region]
        for x, d in enumerate(docs):
            for e in docs[x + 1 :]:
                least, most = sorted((len(sets[d]), len(sets[e])))
                if 100 * least < 80 * most:
                    continue
                both = len(np.intersect1d(sets[d], sets[e], assume_unique=True))
                if 100 * both >= 80 * (least + most - both):
                    kept += 1
                    assert (d, e) in pairs or {(region, d), (region, e)} <= dense
    assert kept > 10_000
    assert not {d for _, d in dense} & set(range(30)) and not {d for p in pairs for d in p} & set(range(6, 30))  # those share nothing


def test_texts_of_crowded_regions_travel_only_where_sets_may_link(spark, monkeypatch):
    """With more common shingles than can come late, documents that share a passage crowd regions; before, the texts of all were dealt out."""
    monkeypatch.setattr(jaccard, "LATE", 0)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = [f"p{k}" for k in range(80)]
    texts = {k: " ".join([*passage, *word(120)]) for k in range(150)}
    texts |= {k: texts[k - 200] + f" end{k}" for k in range(200, 205)}
    core = " ".join([*passage, *word(120)])
    texts |= {k: core + f" other{k}" for k in range(300, 330)}
    written = {}

    def cut(df, name, like=None, old=common.cut):
        out = old(df, name, like)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    got = by_id(jaccard.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)), "n_shingles", "component_id")
    assert got == components_by_force(list(texts.items()))
    assert written["crowded"][0] > 1000
    assert written["texts"] == [40]
