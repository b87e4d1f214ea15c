"""The queries of the training-data operators, with production parameters over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, language, lines, mixing, neighbours, quality, substrings, token_counts, warc
from tessella.llm.common import read

VOCABULARY = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), token_counts.load_vocabulary(vocabulary))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): the digest is of the kept text, of an empty one for null."""
    done = lines.deduplicate(read(spark, sf_dir, "documents"), stats=True, every=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM s),
ks AS (SELECT DISTINCT k FROM bw),
dx AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dx),
hits AS (SELECT rid, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
cov AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""

#: Exact search, which the operator's is at small numbers of vectors.
OP5_SQL = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
ok AS (
  SELECT DISTINCT vec_id, len(x) AS dim, x FROM v
  WHERE len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         max(list_inner_product(q.x, c.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(c.x, c.x)))) AS score
  FROM ok q JOIN ok c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM sh l JOIN sh r ON l.g = r.g AND l.doc_id < r.doc_id GROUP BY l.doc_id, r.doc_id),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE counted AS (
  SELECT row_number() OVER () AS rid, doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sized AS (
  SELECT *, CAST(CAST('0x' || substr(md5(concat_ws(':', 'mix', CAST(id AS VARCHAR), CAST(size AS VARCHAR))), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM counted),
per AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM per),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
filled AS (
  SELECT source, n_docs, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target FROM levels),
wholes AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END + CAST(1e-12 AS DOUBLE)) AS BIGINT) AS whole,
         greatest(1, CAST(ceil(CAST(n_docs AS DOUBLE) / 1000) AS BIGINT)) AS buckets
  FROM filled),
needs AS (SELECT *, greatest(target - CAST(whole * source_size AS DOUBLE), CAST(0 AS DOUBLE)) AS need FROM wholes),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN need / CAST(source_size AS DOUBLE) ELSE 0 END AS p FROM needs),
goals AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN p / (1 - p) ELSE CAST(1 AS DOUBLE) END AS odds FROM shares),
placed AS (
  SELECT rid, id, s.source, size, u / (1 - u) / odds AS q, source_size, target, whole, need, CAST(floor(u * buckets) AS BIGINT) AS bucket
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
sums AS (SELECT source, bucket, CAST(sum(size) AS DOUBLE) AS words, any_value(need) AS need FROM placed GROUP BY source, bucket),
reached AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM sums),
edges AS (
  SELECT source, bucket AS edge, need, need - upto + words AS room
  FROM reached WHERE upto >= need QUALIFY row_number() OVER (PARTITION BY source ORDER BY bucket) = 1),
entries AS (
  SELECT e.source, id, size, q, any_value(e.need) AS need, any_value(room) AS room, count(*) AS n
  FROM placed p JOIN edges e ON p.source IS NOT DISTINCT FROM e.source AND p.bucket = e.edge GROUP BY e.source, id, size, q),
line AS (SELECT *, sum(size * n) OVER (PARTITION BY source ORDER BY q, id, size ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY source ORDER BY q, id, size) AS pos FROM entries),
stops AS (SELECT source, pos AS stop FROM line WHERE cum > room QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) = 1),
tries AS (SELECT l.source, l.id, l.size, l.need, l.room, n, cum, pos, stop, k, greatest(stop - 1 - k // 8, 0) AS kept, max(pos) OVER (PARTITION BY l.source) AS most
          FROM line l JOIN stops s ON l.source IS NOT DISTINCT FROM s.source, range(0, 64) AS t(k)),
draws AS (
  SELECT source, id, size, need, n AS still, k, room - max(CASE WHEN pos = kept THEN cum ELSE 0 END) OVER (PARTITION BY source, k) AS room, pos > kept AS used,
         (CASE WHEN pos >= stop THEN pos - stop ELSE most - stop + pos - kept END - ((k % 8) * (most - kept)) // 8 + most - kept) % greatest(most - kept, 1) AS step
  FROM tries),
walk AS (
  SELECT source, k, CAST(-1 AS BIGINT) AS step, any_value(room) AS room, any_value(need) AS need, CAST(NULL AS BIGINT) AS taken, CAST(NULL AS BIGINT) AS taken_size, CAST(0 AS BIGINT) AS m, CAST(NULL AS BIGINT) AS over_size, CAST(NULL AS BIGINT) AS over_id
  FROM draws WHERE used GROUP BY source, k
  UNION ALL
  SELECT w.source, w.k, d.step, w.room - d.size * f.m, w.need, d.id, d.size, f.m,
         CASE WHEN d.size = 0 OR f.m = d.still OR (w.over_size, w.over_id) < (d.size, d.id) THEN w.over_size ELSE d.size END,
         CASE WHEN d.size = 0 OR f.m = d.still OR (w.over_size, w.over_id) < (d.size, d.id) THEN w.over_id ELSE d.id END
  FROM walk w JOIN draws d ON w.source IS NOT DISTINCT FROM d.source AND w.k = d.k AND d.used AND d.step = w.step + 1,
       LATERAL (SELECT CASE WHEN d.size > 0 THEN least(d.still, CAST(floor(w.room / d.size) AS BIGINT)) ELSE 0 END AS m) f),
ends AS (
  SELECT source, k, need, room, over_size, over_id, coalesce(over_size < 2 * room, false) AS nearer
  FROM walk QUALIFY row_number() OVER (PARTITION BY source, k ORDER BY step DESC) = 1),
best AS (
  SELECT e.*, greatest(stop - 1 - k // 8, 0) AS kept FROM ends e JOIN stops s ON e.source IS NOT DISTINCT FROM s.source
  QUALIFY row_number() OVER (PARTITION BY e.source ORDER BY floor(CASE WHEN nearer THEN over_size - room ELSE room END / greatest(CAST(1 AS DOUBLE), CAST(0.002 AS DOUBLE) * need)), k) = 1),
picks AS (
  SELECT l.source, id, size, n AS m FROM line l LEFT JOIN best b ON l.source IS NOT DISTINCT FROM b.source WHERE kept IS NULL OR pos <= kept
  UNION ALL SELECT w.source, w.taken, w.taken_size, w.m FROM walk w JOIN best b ON w.source IS NOT DISTINCT FROM b.source AND w.k = b.k WHERE w.m > 0
  UNION ALL SELECT source, over_id, over_size, 1 FROM best WHERE nearer),
chosen AS (SELECT source, id, size, sum(m) AS m FROM picks GROUP BY source, id, size),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, id, size ORDER BY rid) AS nth FROM placed)
SELECT p.id AS doc_id, p.size, source_size, target, p.source AS source,
       CAST(p.size * (whole + CASE WHEN bucket < edge THEN 1 WHEN bucket = edge AND nth <= coalesce(c.m, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM numbered p LEFT JOIN edges e ON p.source IS NOT DISTINCT FROM e.source
LEFT JOIN chosen c ON c.source IS NOT DISTINCT FROM p.source AND c.id IS NOT DISTINCT FROM p.id AND c.size = p.size
"""

OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM x),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (win) WHERE doc_id > first),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d WHERE len(w) > 0),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM (SELECT * FROM words ANTI JOIN gone USING (rid, j)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS keep FROM p GROUP BY html)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM p JOIN m USING (html)
"""

ORACLES = {"op4_benchmark_decontamination": OP4_SQL, "op5_nearest_neighbours": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op8_source_mixing": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_warc": OP10_SQL}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality_classifier, op3_token_counts, op4_benchmark_decontamination, op5_nearest_neighbours,
        op6_ngram_jaccard_join, op7_line_dedup, op8_source_mixing, op9_substring_dedup, op10_warc,
    )
}
