"""The pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from test_cases import ROWS, SCHEMA
from test_operators import LOWER, components_by_force, lines_by_force

import corpus_pipeline
from tessella.llm import mixing, quality
from tessella.llm.common import cut, read

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_stages_do_what_they_say(spark, sf):
    docs = read(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == before.columns
        seen[name] = (before, docs)

    before, after = seen["quality"]
    good = {r.doc_id for r in quality.score(before, quality.fit(before, read(spark, sf, "labels"))).where("predicted = 1").collect()}
    assert {i for i, _ in texts_of(after)} == good and len(good) < before.count()

    before, after = seen["line_dedup"]
    kept = {i: t for i, (n, gone, t) in lines_by_force(texts_of(before)).items() if gone < n or not n}
    assert dict(texts_of(after)) == kept
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text != dict(texts_of(before))[r.doc_id])

    before, after = seen["jaccard_join"]
    assert {i for i, _ in texts_of(after)} == {i for i, (_, c) in components_by_force(texts_of(before)).items() if i == c}

    before, after = seen["decontamination"]
    windows = set()
    for r in read(spark, sf, "benchmark").collect():
        w = PLAIN.findall((r.text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    clean = set()
    for i, t in texts_of(before):
        w = PLAIN.findall((t or "").translate(LOWER))
        if not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)):
            clean.add(i)
    assert {i for i, _ in texts_of(after)} == clean

    before, after = seen["mixing"]
    copies = Counter(i for i, _ in texts_of(after))
    for r in mixing.mix(before).collect():
        assert copies[r.doc_id] * r["size"] == r.taken


def test_run(spark, sf):
    a, b = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert a.columns == read(spark, sf, "documents").columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_cases(spark, sf, name):
    """Odd rows, further columns and an empty table go through each stage."""
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "g", "p", 1, 2, "c") for r in ROWS], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    if name in ("line_dedup", "jaccard_join", "decontamination"):
        ids = Counter(r.doc_id for r in got.collect())
        want = Counter(r[0] for r in ROWS)
        if name == "line_dedup":
            want -= Counter([7])
        if name == "jaccard_join":
            want -= Counter([2, 2, 7])
        assert ids == want
    else:
        got.collect()
    assert stage(spark, docs.where("doc_id = -5"), sf).collect() == []
