"""The training-data operators against brute force on the smallest fixture."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import duck, same_rows
from pyspark.sql import functions as F

from tessella.llm import entry, jaccard, language, lines, mixing, neighbours, quality, substrings, token_counts, warc
from tessella.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, sf, name):
    same_rows(entry.QUERIES[name](spark, sf), duck(sf), entry.ORACLES[name])


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language(spark, sf, docs):
    got = by_id(entry.op1_language_id(spark, sf), "held_out", "lang_pred", "score")
    assert len(got) == docs.count()
    assert all(v[0] == held(i) and 0 <= v[2] <= 1 for i, v in got.items())
    truth = dict(docs.select("doc_id", "lang").collect())
    right = [got[i][1] == truth[i] for i in got if held(i)]
    assert sum(right) / len(right) >= 0.95


def test_language_learns_nothing_from_held_out_rows(docs):
    kept = docs.where(~F.col("doc_id").isin([i for i in range(400) if held(i)]))
    a, b = (language.sample(d, 50, "doc_id", "text", "lang") for d in (docs, kept))
    assert a == b and len(a[0]) == 50


def test_window_probabilities_are_those_of_one_by_one():
    rng = np.random.default_rng(0)
    net = language.train([b"the cat sat on it" * 20, b"der hund war da" * 20] * 4, ["en", "de"] * 4, epochs=2)
    data = rng.integers(1, 255, 3000).astype(np.uint8)
    bounds = np.array([0, 0, 700, 956, 3000])
    best, p = language.Predictor(net).texts(data, bounds)
    for i in range(4):
        part = data[bounds[i] : bounds[i + 1]]
        each = net.probabilities(language.cut_windows(part))
        size = np.array([max(1, min(256, len(part) - 256 * k)) for k in range(len(each))])
        mean = (each * size[:, None]).sum(0) / size.sum()
        assert best[i] == mean.argmax() and p[i] == pytest.approx(mean.max(), abs=1e-5)


def test_quality(spark, sf, docs):
    got = by_id(entry.op2_quality_classifier(spark, sf), "held_out", "score", "predicted")
    assert all(v[0] == held(i) and 0 <= v[1] <= 1 and v[2] == int(v[1] >= 0.5) for i, v in got.items())
    truth = dict(read(spark, sf, "labels").select("doc_id", "quality").collect())
    right = [got[i][2] == truth[i] for i in truth if held(i)]
    assert sum(right) / len(right) >= 0.9
    kept = quality.score(docs, quality.fit(docs, read(spark, sf, "labels")), keep=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2]) and kept.columns == docs.columns


def test_attention_gradient():
    """Training on bags of which one passage tells the label finds that passage."""
    good, bad = b"plain words that follow one another here. " * 30, b"### *** ### $$$ ### *** " * 20
    model = quality.train([good, good + bad, good * 2, bad + good] * 10, [1, 0, 1, 0] * 10)
    encoder = quality.Encoder()
    x, n = encoder.passages(np.frombuffer(good + bad, np.uint8), np.array([0, len(good + bad)]))
    f = model.forward(x, n)
    assert f["y"][0] < 0.5 and f["e"][-1] > f["e"][0]


TRICKY = [
    "", "   ", "Σίσυφος ΟΔΟΣ ΟΔΟΣ.", "a<|endoftext|>B  c<|startoftext|>", "<|endoftext|><|endoftext|>", "x\x1cy\x1fz\x85q w　v", "é É İstanbul", "é ẛ̣", "don't I'LL we've 123 ½ ² ٣ !!!??",
    "你好世界 😀😀", "a" * 500, "ab" * 400, "​﻿x", "<|endoftext|", "\x00\x01", "'s's't",
]


def test_tokens(spark, sf, texts):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path(entry.VOCABULARY)
    library = tokenizers.Tokenizer.from_file(path)
    got = by_id(entry.op3_token_counts(spark, sf), "n_bytes", "n_tokens", "over_limit")
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    counter = token_counts.TokenCounter(token_counts.load_vocabulary(path))
    for t in TRICKY:
        assert counter.tokens(t) == len(library.encode(t, add_special_tokens=False).ids), t
    assert unicodedata.is_normalized("NFC", "é")


def test_neighbours(spark, sf):
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in vectors], float)
    ids = np.array([r.vec_id for r in vectors])
    norm = np.sqrt((x * x).sum(1))
    got = defaultdict(list)
    for r in entry.op5_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    found = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = (x * x[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((ids, -s))[:5]
        mine = got[ids[q]]
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, score in mine)
        found += len({v for _, v, _ in mine} & set(ids[best].tolist()))
        total += 5
    assert found / total >= 0.9


def test_recall_when_not_all_buckets_are_probed(spark, sf, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 1)
    monkeypatch.setattr(neighbours, "LEAST_PROBES", 24)
    few = neighbours.nearest(read(spark, sf, "embeddings"))
    exact = by_id(entry.op5_nearest_neighbours(spark, sf).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")), "v", key="query_id")
    got = by_id(few.groupBy("query_id").agg(F.collect_set("vec_id").alias("v")), "v", key="query_id")
    assert sum(len(set(exact[q][0]) & set(got.get(q, ([],))[0])) for q in exact) >= 0.9 * 5 * len(exact)


def test_recall_beyond_the_size_of_a_part(spark, monkeypatch):
    """As few probes as at any size, and buckets in several parts: most neighbours are found, and the parts change nothing."""
    vectors = read(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    find = lambda: by_id(neighbours.nearest(vectors).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("v")), "v", key="query_id")
    exact = find()
    monkeypatch.setattr(neighbours, "CANDIDATES", 1)
    whole = find()
    monkeypatch.setattr(neighbours, "PER_PART", 300)
    few = find()
    assert few == whole
    assert sum(len({x.vec_id for x in exact[q][0]} & {x.vec_id for x in few[q][0]}) for q in exact) >= 0.92 * 5 * len(exact)


def test_long_vectors_are_searched_exactly_at_small_numbers(spark):
    x = np.random.default_rng(4).normal(size=(300, 768))
    got = by_id(neighbours.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")), "v", key="query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -9
        assert set(got[q][0]) == set(np.argsort(-s)[:5].tolist())


def test_rotations():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = neighbours.Rotations(48, 2)
    assert np.allclose(np.linalg.norm(r.rotated(x, 0, 0), axis=1), 1)
    first, many = r.probes(x, 3, 1), r.probes(x, 3, 40)
    assert (first[:, 0] == many[:, 0]).all() and all(len(set(row)) == 40 for row in many.tolist())
    y0, y1 = (np.concatenate([y, -y], 1) for y in (r.rotated(x, 3, 0), r.rotated(x, 3, 1)))
    assert (first[:, 0] == y0.argmax(1) * 128 + y1.argmax(1)).all()


def components_by_force(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, root = defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sorted(sets.items()):
        for j, k in Counter(j for g in s for j in where[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("region", "block"), [(16, 1 << 22), (2, 1 << 22), (2, 0)])
def test_jaccard(docs, texts, monkeypatch, region, block):
    """With small regions everything is joined by blocks of near copies, and with small blocks region by region."""
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert by_id(jaccard.groups(docs), "n_shingles", "component_id") == components_by_force(texts)


def test_jaccard_near_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    made = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            w[k] = f"x{i}_{k}"
        made.append((i, " ".join(w)))
    made += [(200 + i, " ".join([*base[:30], *(f"y{i}_{k}" for k in range(30))])) for i in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = components_by_force(made)
    for block in (1 << 22, 0):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert by_id(jaccard.groups(df), "n_shingles", "component_id") == want


def lines_by_force(texts):
    first = {}
    for i, t in texts:
        for _, _, raw in lines.chunks_of(t):
            first.setdefault(raw, i)
    out = {}
    for i, t in texts:
        if t is None or t == "":
            out[i] = (0, 0, t)
            continue
        own, seen = t.split("\n"), set()
        keep = [True] * len(own)
        for a, b, raw in lines.chunks_of(t):
            if first[raw] < i or raw in seen:
                keep[a:b] = [False] * (b - a)
            seen.add(raw)
        out[i] = (len(own), keep.count(False), "\n".join(x for x, k in zip(own, keep, strict=True) if k))
    return out


def test_lines(docs, texts):
    want = lines_by_force(texts)
    assert by_id(lines.deduplicate(docs, stats=True), "n_lines", "n_removed", "kept") == want
    assert sum(v[1] for v in want.values()) > 0


def test_every_repeated_run_of_lines_goes(spark, sf, texts):
    """Pairs of adjacent lines, found without chunks, that stand in a document of smaller id or before in the same one."""
    first, want, runs = {}, {}, 0
    for i, t in texts:
        own = (t or "").split("\n")
        for p in zip(own, own[1:], strict=False):
            first.setdefault(p, i)
    for i, t in texts:
        own, seen = (t or "").split("\n"), {}
        gone = set()
        for k, p in enumerate(zip(own, own[1:], strict=False)):
            if first[p] < i or seen.setdefault(p, k) <= k - 2:
                gone |= {k, k + 1}
        runs += len(gone)
        kept = "\n".join(x for k, x in enumerate(own) if k not in gone)
        want[i] = (len(own) if t else 0, len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert by_id(entry.op7_line_dedup(spark, sf), "n_lines", "n_removed", "kept_sha256") == want and runs > 0


def test_a_run_goes_wherever_it_stands(spark):
    data = [(1, "p\nq\nr\ns"), (2, "a\nq\nr\nb"), (3, "c\nd\np\nq\nr\ns\ne"), (4, "x\ny\nz\nx\ny"), (5, "m\nm\nm"), (6, "q\nn\nr"), (None, "q\nr\nu")]
    got = by_id(lines.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), stats=True, every=True), "n_removed", "kept")
    assert got == {1: (0, "p\nq\nr\ns"), 2: (2, "a\nb"), 3: (4, "c\nd\ne"), 4: (2, "x\ny\nz"), 5: (0, "m\nm\nm"), 6: (0, "q\nn\nr"), None: (0, "q\nr\nu")}


def test_chunks_shift_with_their_lines():
    rng = np.random.default_rng(2)
    passage = [f"line {k}" for k in rng.integers(0, 10**6, 60)]
    a = {raw for _, _, raw in lines.chunks_of("\n".join(passage))}
    b = {raw for _, _, raw in lines.chunks_of("\n".join(["new first line", *passage]))}
    assert len(a & b) >= 0.8 * len(a)
    for text in ("\n".join(passage), "a\nb", "a\nb\nc"):
        cuts = list(lines.chunks_of(text))
        assert [c[0] for c in cuts[1:]] == [c[1] for c in cuts[:-1]] and cuts[-1][1] == text.count("\n") + 1
        assert all(2 <= e - s <= lines.MOST + 1 for s, e, _ in cuts)


def test_mixing(spark, sf, docs, texts):
    got = entry.op8_source_mixing(spark, sf)
    again = entry.op8_source_mixing(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    size = {i: len(WORD.findall(t or "")) for i, t in texts}
    source = dict(docs.select("doc_id", "source").collect())
    total, by = Counter(), defaultdict(list)
    for i in size:
        total[source[i]] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    for r in got.collect():
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s])
        assert r.taken % r["size"] == 0 and 0 <= r.taken <= 2 * r["size"] if r["size"] else r.taken == 0
        by[s].append(r.taken)
    for s in names:
        assert abs(sum(by[s]) - target[s]) <= max(50, 0.05 * target[s]), s
    rows = Counter(r.doc_id for r in mixing.apply_mix(docs).select("doc_id").collect())
    assert all(rows[r.doc_id] * r["size"] == r.taken for r in got.collect())


def test_mixing_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substrings_in_batches(spark, docs, texts):
    want = by_id(substrings.deduplicate(docs), "n_words", "n_removed", "kept_sha256")
    for share in (0.0, 0.6, 1.0):
        assert by_id(substrings.deduplicate(docs, history_share=share), "n_words", "n_removed", "kept_sha256") == want
    kept = by_id(substrings.deduplicate(docs, with_text=True), "kept", "kept_sha256")
    assert all(hashlib.sha256(k.encode()).hexdigest() == h for k, h in kept.values())


def test_index_compacts(spark, docs):
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    index = substrings.FingerprintIndex(spark, 6)
    for k in range(substrings.FANOUT + 1):
        hits = index.ingest(rows.where(F.col("id") % (substrings.FANOUT + 1) == k))
    assert len(index.runs) == 2
    assert hits.count() > 0


def test_a_false_fingerprint_is_found_out(spark, monkeypatch):
    """Fingerprints of the first seed that are all equal: the digests differ, and the next seed gives the right result."""
    original = substrings.fingerprint_rows

    def blind(docs, bits, width, seed, repeated=None):
        if seed:
            return original(docs, bits, width, seed, repeated)
        seen.append(seed)
        return original(docs.withColumn("text", F.regexp_replace("text", "[a-z][0-9]", "x")), bits, width, seed, repeated)

    seen: list[int] = []
    monkeypatch.setattr(substrings, "fingerprint_rows", blind)
    a, b = " ".join(f"a{k}" for k in range(10, 24)), " ".join(f"b{k}" for k in range(10, 24))
    df = spark.createDataFrame([(1, a), (2, b.replace("b", "c")), (3, a)], "doc_id long, text string")
    assert by_id(substrings.deduplicate(df), "n_removed") == {1: (0,), 2: (0,), 3: (14,)} and seen


def test_warc(spark, sf, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u4\r\nX: y", ""), (5, "u5", "<p>\r\n\r\nWARC/1.1 é</p>" * 5000)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.plan_revisits(pages), folder)
    got = {r.page_id: r for r in warc.read_archives(manifest, folder).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {1: ("revisit", 2, 8), 2: ("response", None, 8), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 25 * 5000 - 5000)} or got[5].payload_bytes == len(("<p>\r\n\r\nWARC/1.1 é</p>" * 5000).encode())
    assert got[5].payload == ("<p>\r\n\r\nWARC/1.1 é</p>" * 5000).encode() and got[1].payload is None
    path = manifest.first().path
    raw = open(path, "rb").read()
    assert raw.count(b"\x1f\x8b\x08") >= 1
    import io

    whole = list(warc.read_records(io.BytesIO(raw)))
    for size in (1, 7):
        monkey = [r for blocks in [warc.members(io.BytesIO(raw), size)] for r in (b"".join(m) for m in blocks)]
        assert len(monkey) == len(whole)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[: len(raw) // 2])))
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    broken = zlib.decompress(warc.encode_record(9, "u", b"payload", None, False), 31).replace(b"payload", b"pAyload")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(member.compress(broken) + member.flush())))


def test_hits_within_a_share():
    rng = np.random.default_rng(1)
    ids, pos, fps = rng.integers(0, 40, 2000), np.arange(2000), rng.integers(0, 600, 2000).astype(np.uint64)
    least: dict[int, tuple[int, int]] = {}
    for i, p, f in zip(ids.tolist(), pos.tolist(), fps.tolist(), strict=True):
        least[f] = min(least.get(f, (i, p)), (i, p))
    hit, first = substrings.hits_within(ids, pos, fps)
    want = {p: least[f][1] for i, p, f in zip(ids.tolist(), pos.tolist(), fps.tolist(), strict=True) if i > least[f][0]}
    assert dict(zip(hit.tolist(), first.tolist(), strict=True)) == want


@pytest.mark.parametrize("parts", [1, 3])
def test_a_region_crowded_within_a_share(spark, parts):
    """Sixty near copies, each with a last word of its own, and copies of them; texts apart stay apart."""
    base = " ".join(f"w{k}" for k in range(60))
    data = [(k, f"{base} end{k % 50}") for k in range(5, 65)] + [(1, "a b c d e f g"), (70, "h i j k l m n")]
    got = by_id(jaccard.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)), "n_shingles", "component_id")
    assert got == {k: (57, 5) for k in range(5, 65)} | {1: (3, 1), 70: (3, 70)}


@pytest.mark.parametrize("times", [16, 17, 40])
def test_a_row_that_repeats_crowds_no_region(spark, times):
    base = " ".join(f"w{k}" for k in range(60))
    data = [(1, f"{base} first")] * times + [(2, f"{base} second"), (3, f"{base} third")]
    got = jaccard.groups(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == times + 2 and {r.component_id for r in got} == {1}
