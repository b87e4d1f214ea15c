"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: each operator's defined result."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, language, lines, mixing, neighbours, quality, substrings, token_counts, warc

LONG = " ".join(f"word{k % 977} and{k}" for k in range(40_000)) + "\nlast line"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, gone string, packed string, n int, size int, component string"
ROWS = [
    (1, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (3, None, None, None), (4, "", "en", None), (5, " \n\t ", "de", "b"), (6, LONG, "en", "a"),
    (7, LONG, None, "a"), (None, PASSAGE, "en", "a"), (None, None, None, None), (8, "zu kurz", "de", "b"), (9, "x y\nq r\n" * 3, "en", "é"), (10, "12 34 !!", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "g", "p", 1, 2, "c") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -5")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_language(docs, none):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (10, "und"), (None, "und")} <= got and language.identify(docs).count() == len(ROWS)
    assert language.identify(none).collect() == []
    assert {(r.lang_pred, r.score) for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0), ("und", 1.0)}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (6, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert quality.score(none, model).collect() == [] and quality.fit(none, labels) is None
    assert {(r.score, r.predicted) for r in quality.score(docs, None).collect()} == {(0.5, 1)}
    assert quality.score(docs, None, keep=True).columns == docs.columns


def test_tokens(docs, none):
    import public_tokenizers

    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(token_counts.count_tokens(docs, vocabulary), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert len(got) == len(ROWS) and (3, 0, 0, False) in got and (4, 0, 0, False) in got and (5, 4, 0, False) in got
    assert all(r[3] for r in got if r[0] in (6, 7))
    assert token_counts.count_tokens(none, vocabulary).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_decontamination(spark, docs, none, block):
    items = spark.createDataFrame([("q1", "TWO three-four FIVE six; seven eight nine ten eleven!", 1), ("q1", "two three four five six seven eight nine ten eleven", 1), ("q2", "zu kurz", 2), ("q3", None, 3), ("q4", "?!", 4), (None, "12 34", 5)], "item_id string, text string, n_words int")
    got = rows(decontaminate.contamination(docs, items, block_bytes=block), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    q1, q2 = decontaminate.digest(["q1"]), decontaminate.digest(["q2"])
    assert [r for r in got if r[0] == 2] == [(2, 15, 10, 1, q1, True)] * 2 and (None, 15, 10, 1, q1, True) in got
    assert (8, 2, 2, 1, q2, True) in got and (3, 0, 0, 0, EMPTY, False) in got and (10, 2, 2, 1, EMPTY, True) in got and len(got) == len(ROWS)
    scanned = {r.doc_id: r for r in decontaminate.scan(docs, items, block_bytes=block).collect()}
    assert [PASSAGE.encode()[s.start : s.stop] for s in scanned[1].spans] == [b"two three four five six seven eight nine ten eleven"]
    assert decontaminate.contamination(none, items, block_bytes=block).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.where("n_words = 9")).collect())


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "vec_id long, embedding array<float>, rank int, score double")
    got = rows(neighbours.nearest(df), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 1.0), (0, 4, 9, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 1.0), (50, 4, 9, 0.0)]
    assert neighbours.nearest(df.where("vec_id = -1")).collect() == []
    copies = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    top = rows(neighbours.nearest(copies), "query_id", "rank", "vec_id")
    assert len(top) == 300 and [r[2] for r in top if r[0] == 2950] == [0, 1, 2, 3, 4] and sorted(r[2] for r in top if r[0] == 0) == [1, 2, 3, 4, 5]


def test_neighbours_of_double_precision(spark):
    """Vectors that differ by less than single precision can tell are neither one class nor of one score."""
    data = [(0, [1.0, 0.0]), (1, [1.0, 2e-8]), (2, [1.0 + 1e-12, 1.0]), (3, [1.0, 1.0])]
    got = rows(neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "query_id", "rank", "vec_id", "score")
    assert [r[2] for r in got] == [1, 2, 3] and got[1][3] > got[2][3]


def test_jaccard(docs, none):
    got = rows(jaccard.groups(docs), "doc_id", "n_shingles", "component_id")
    assert len(got) == len(ROWS) and got.count((2, 11, 1)) == 2 and (1, 11, 1) in got and (None, 11, None) in got and (None, 0, None) in got
    assert (3, 0, 3) in got and (4, 0, 4) in got and (5, 0, 5) in got and (8, 1, 8) in got
    assert [r[2] for r in got if r[0] in (6, 7)] == [6, 6]
    assert jaccard.groups(none).collect() == []


def test_an_id_with_two_texts_links_both(spark):
    other = PASSAGE.replace("t", "z")
    df = spark.createDataFrame([(1, PASSAGE), (5, PASSAGE), (5, other), (7, other)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.groups(df).collect()} == {1}


def test_lines(docs, none):
    got = rows(lines.deduplicate(docs, stats=True), "doc_id", "n_lines", "n_removed", "kept")
    assert len(got) == len(ROWS) and (3, 0, 0, None) in got and (4, 0, 0, "") in got
    assert (6, 2, 0, LONG) in got and (7, 2, 2, "") in got and got.count((2, 1, 0, PASSAGE)) == 2
    full = lines.deduplicate(docs)
    assert full.columns == [*docs.columns, "__lines", "__removed"]
    assert lines.deduplicate(none).collect() == []


def test_mixing(docs, none):
    got = rows(mixing.mix(docs), "doc_id", "size", "source_size", "target", "taken", "source")
    assert len(got) == len(ROWS) and (3, 0, 0, 0.0, 0, None) in got
    assert all(r[4] <= 2 * r[1] for r in got)
    assert sum({r[5]: r[3] for r in got}.values()) == pytest.approx(1.5 * sum(r[1] for r in got))
    assert mixing.mix(none).collect() == [] and mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(none).collect() == []
    one = docs.where("source = 'é'")
    assert rows(mixing.mix(one), "taken", "size") in ([(12, 12)], [(24, 12)])


def test_substrings(docs, none):
    got = rows(substrings.deduplicate(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert len(got) == len(ROWS) and (3, 0, 0, EMPTY) in got and (4, 0, 0, EMPTY) in got
    assert got.count((2, 15, 15, EMPTY)) == 2 and [r[2] for r in got if r[0] == 1] == [0] and [r[2] for r in got if r[0] is None] == [0, 0]
    n = len(LONG.split())
    assert (7, n, n, EMPTY) in got and [r[2] for r in got if r[0] == 6] == [0]
    assert substrings.deduplicate(none).collect() == []


def test_an_id_with_two_texts_is_removed_by_neither(spark):
    df = spark.createDataFrame([(5, PASSAGE), (5, f"new {PASSAGE}"), (6, PASSAGE), (4, "other words only")], "doc_id long, text string")
    assert rows(substrings.deduplicate(df), "doc_id", "n_removed") == [(4, 0), (5, 0), (5, 0), (6, 15)]


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "a", 1), (1, "u", "a", 2), (None, "u", "a", 3), (None, None, "only", 4), (2, "u", None, 5)], "page_id long, url string, html string, keep int")
    got = rows(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(1, 1, "response", None), (1, 1, "response", None), (None, 1, "revisit", 1), (None, 4, "response", None), (2, 0, "response", None)], key=str)
    assert warc.round_trip(pages.where("keep = 9")).collect() == []
    small = rows(warc.round_trip(pages, least_bytes=2), "record_type")
    assert small == [("response",)] * 5
