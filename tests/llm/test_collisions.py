"""Hashes that meet never decide a result; indexes outlive their session; crowded regions are joined exactly."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import by_id, components_by_force

from tessella.llm import jaccard, substrings
from tessella.llm.words import CHUNK_BYTES, Hasher, exact_grams, ngrams, space_table


def thue_morse() -> tuple[str, str]:
    """A word of 1024 letters and its complement: polynomial hashes modulo 2^64 with an odd base give both the same."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_polynomial_hash_differ(spark):
    x, y = thue_morse()
    twelve = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{twelve} {x}"), (2, f"{twelve} {y}"), (3, f"{twelve} {y}")], "doc_id long, text string")
    assert by_id(substrings.deduplicate(df), "n_removed") == {1: (0,), 2: (0,), 3: (13,)}
    four = spark.createDataFrame([(1, f"x y z q {x}"), (2, f"x y z q {y}"), (3, f"X y z q {y}")], "doc_id long, text string")
    assert by_id(jaccard.groups(four), "n_shingles", "component_id") == {1: (1, 1), 2: (1, 2), 3: (1, 2)}


def test_grams_by_words_and_by_hashes():
    rng = np.random.default_rng(3)
    raws = [" ".join(rng.choice(["a", "b", "c", "A"], int(n))).encode() for n in rng.integers(0, 40, 200)]
    for n in (1, 2, 5, 13):
        numbers, seen, back = exact_grams(Hasher(space_table(), True), raws, n), {}, {}
        for raw, mine in zip(raws, numbers, strict=True):
            w = raw.lower().split()
            want = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
            assert len(want) == len(mine)
            lanes, _ = Hasher(space_table(), True).words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(w) >= n:
                assert len(set(ngrams(lanes, n)[0].tolist())) == len(want)
            for g in want:
                back.setdefault(g, set()).update(mine.tolist())
            seen |= dict.fromkeys(mine.tolist())
        assert len(seen) == len(back)


def test_pieces_of_a_long_text():
    rng = np.random.default_rng(5)
    raw = " ".join(f"w{k}" for k in rng.integers(0, 5000, 3 * CHUNK_BYTES // 4)).encode() + b"x" * (2 * CHUNK_BYTES) + b" end"
    data = np.frombuffer(raw, np.uint8)
    hasher = Hasher(space_table(), False)
    lanes, first = hasher.words(data, np.array([0, len(raw)]))
    both, starts = hasher.words(np.concatenate([data, data]), np.array([0, len(raw), 2 * len(raw)]))
    assert first[1] == len(raw.split()) and (both[:, : starts[1]] == lanes).all() and (both[:, starts[1] :] == lanes).all()


def test_rows_of_one_id_with_other_texts(spark):
    """Texts of one id of which a short one could be taken for a long one: each loses what it shares with smaller ids."""
    passage = " ".join(f"p{k}" for k in range(15))
    long = " ".join(f"q{k}" for k in range(100)) + " " + passage
    df = spark.createDataFrame([(1, passage), (5, long), (5, "only four words here"), (5, passage), (6, long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicate(df).collect())
    assert got == [(1, 15, 0), (5, 4, 0), (5, 15, 15), (5, 115, 15), (6, 115, 115)]


def test_false_stretches_are_looked_up_by_their_words(spark, monkeypatch):
    """Fingerprints that tell nothing of some words: repeats are found behind windows that only looked the same."""
    original = substrings.fingerprint_rows
    monkeypatch.setattr(substrings, "fingerprint_rows", lambda docs, *rest, **more: original(docs.withColumn("text", F.regexp_replace("text", "[a-z]([0-9])", "x$1")), *rest, **more))
    run = lambda letter, n=20: " ".join(f"{letter}{k}" for k in range(n))
    data = [(1, run("a")), (2, run("b")), (3, run("c") + " tail " + run("a", 14)), (4, "head " + run("b", 16)), (5, run("c", 13)), (6, run("a")), (7, run("b", 12) + " e"), (8, "nothing to see")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got == [(1, 20, 0), (2, 20, 0), (3, 35, 14), (4, 17, 16), (5, 13, 13), (6, 20, 20), (7, 13, 0), (8, 3, 0)]


def removed_by_force(texts):
    first, out = {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    for i, w in split.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = (len(w), len(gone))
    return out


def test_an_index_is_taken_up_again(spark, sf, tmp_path):
    """Batches of one session each: every session finds what earlier ones left, and the results are those of one batch."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = removed_by_force(texts), {}
    path, border = f"file://{tmp_path}/index", 0
    substrings.FingerprintIndex(spark, 6, path=path)._commit([])
    for number in range(6):
        session = spark.newSession()
        index = substrings.FingerprintIndex.open(session, path)
        assert index.version >= number and len(index.runs) < substrings.FANOUT
        known, border = border, border + len(texts) // 6 + 1
        mine = session.read.parquet(f"{sf}/documents.parquet").where((F.col("doc_id") >= known) & (F.col("doc_id") < border))
        got |= by_id(substrings.deduplicate_against(index, mine, docs.where(F.col("doc_id") < known)), "n_words", "n_removed")
        index.vacuum()
    assert got == want and any(v[1] for v in want.values())
    last = substrings.FingerprintIndex.open(spark, path)
    assert len(last.runs) == 3  # one of four runs, and two after it
    left = [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("run-")]
    assert sorted(left) == sorted(r.rsplit("/", 1)[1] for r in last.runs)
    with pytest.raises(FileNotFoundError):
        substrings.FingerprintIndex.open(spark, f"file://{tmp_path}/nothing")


@pytest.mark.parametrize(("part", "rounds", "pivots"), [(256, 2, 4), (3, 1, 1), (5, 1, 3)])
def test_crowded_regions_are_joined_exactly(spark, monkeypatch, part, rounds, pivots):
    """Families of near copies around the threshold that share common lines; few pivots leave most of the work to the cells."""
    for name, value in (("PART", part), ("ROUNDS", rounds), ("PIVOTS", pivots)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(11)
    base, made = [f"w{k}" for k in range(80)], []
    for family in range(4):
        kin = [f"f{family}_{k}" if k % 9 == family else w for k, w in enumerate(base)]
        for i in range(40):
            w = list(kin)
            at = int(rng.integers(0, 70))
            w[at : at + int(rng.integers(0, 9))] = [f"y{int(rng.integers(0, 6))}"]
            made.append((family * 100 + i, " ".join(w)))
    got = by_id(jaccard.groups(spark.createDataFrame(made, "doc_id long, text string")), "n_shingles", "component_id")
    want = components_by_force(made)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(made)


def test_ids_of_several_texts_in_crowded_regions(spark, monkeypatch):
    """Two texts share an id: a link of either counts, whichever is nearer to a pivot."""
    for name, value in (("PART", 3), ("ROUNDS", 1), ("PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(5)
    made = []
    for family in range(2):
        kin = [f"f{family}_{k}" if k % 9 == family else f"w{k}" for k in range(80)]
        for i in range(40):
            w = list(kin)
            at = int(rng.integers(0, 70))
            w[at : at + int(rng.integers(0, 9))] = [f"y{int(rng.integers(0, 6))}"]
            made.append((family * 100 + i, " ".join(w)))
    # an id that holds a text of each family connects them
    rows = made + [(7, made[45][1]), (7, made[3][1]), (7, made[3][1])]
    apart = components_by_force([(k, t) for k, (_, t) in enumerate(rows)])
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (_, c) in apart.items():
        a, b = find(rows[k][0]), find(rows[c][0])
        root[max(a, b)] = min(a, b)
    got = {(r.doc_id, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, find(i)) for i in root}
