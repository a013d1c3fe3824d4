"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stridelake.llm import bpe, langrank, mixing, nbsvm, pii, pstable, simhash_bk, substring_cms, warczip, whitening, winnowing, word_trie
from stridelake.session import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PII_KEY = "surrogates-1"
MIX_SEED = "mix-1"
QUALITY_TRAIN = "crc32(cast(doc_id as string)) % 5 != 0"
LANG_TRAIN = "crc32(cast(doc_id as string)) % 4 != 2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), MIX_SEED)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = nbsvm.score_quality(docs, table(spark, sf_dir, "labels"), QUALITY_TRAIN)
    return scored.select("doc_id", F.expr(f"not ({QUALITY_TRAIN})").alias("held_out"), "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.cosine_links(table(spark, sf_dir, "embeddings"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.round_trip(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langrank.learn_profiles(docs.where(LANG_TRAIN))
    named = langrank.predict_language(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", F.expr(f"not ({LANG_TRAIN})").alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.simhash_components(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_cms.remove_repeats(table(spark, sf_dir, "documents"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = word_trie.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii, op2_mixing, op3_bpe, op4_quality, op5_embedding_dedup, op6_nearest, op7_warc, op8_language, op9_simhash, op10_substrings, op11_winnowing, op12_resampling, op13_whitening, pipeline)}

_OP2 = f"""
WITH sizes AS (SELECT source, coalesce(sum(length(text)), 0) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS total, count(*) FILTER (WHERE size > 0) AS n FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / n * total::DOUBLE / size ELSE 1.0 END AS rate FROM sizes, totals),
mass AS (SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p
         FROM (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS j FROM rates)),
cdf AS (SELECT source, list(c) AS cdf FROM (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM mass) GROUP BY source),
drawn AS (SELECT d.*, ('0x' || substr(sha256('{MIX_SEED}|count|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT drawn.*, len(list_filter(cdf, lambda c: c <= u)) AS n FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, k::BIGINT AS copy, substr(sha256('{MIX_SEED}|order|' || doc_id || '|' || k), 1, 16) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM counted)
"""

_OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS d FROM pages),
low AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, 10 * g + 1, 10))::BIGINT >> (35 - 5 * i)) & 31)::INT + 1, 1) FOR i IN range(8)], '') FOR g IN range(4)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN low USING (d)
"""

_OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS s FROM w WHERE len(ws) >= 13)),
own AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(s, s + 12)) AS p FROM win JOIN own USING (win) WHERE low < doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
lost AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN lost ON words.doc_id = lost.doc_id AND words.p = lost.p GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
n AS (SELECT i, count(*) AS n FROM e GROUP BY i), low AS (SELECT i, min(j) AS low FROM r GROUP BY i)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id IS NOT NULL AND least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n ON n.i = vec_id LEFT JOIN low ON low.i = vec_id
"""

#: crc32 of a number's decimal digits, bit by bit, the lowest first.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}::VARCHAR, ''), lambda d: list_transform(range(8), lambda b: (ascii(d) >> b)::BIGINT & 1)))), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

_OP8 = rf"""
WITH docs AS (SELECT doc_id, lang, text, ({_CRC.format('doc_id')}) % 4 = 2 AS held_out FROM documents),
chars AS (SELECT doc_id, lang, held_out, list_transform(string_split(regexp_replace(' ' || lower(text) || ' ', '[^\p{{L}}]+', '_', 'g'), ''), lambda c: unicode(c)::BIGINT) AS cp FROM docs WHERE text IS NOT NULL),
grams AS (SELECT doc_id, lang, held_out, unnest(list_zip(cp, cp[2:], cp[3:])) AS z FROM chars),
codes AS (SELECT doc_id, lang, held_out, z[1] AS code FROM grams WHERE z[1] <> 95 UNION ALL SELECT doc_id, lang, held_out, z[1] * 2097152 + z[2] FROM grams WHERE z[2] IS NOT NULL
  UNION ALL SELECT doc_id, lang, held_out, (z[1] * 2097152 + z[2]) * 2097152 + z[3] FROM grams WHERE z[3] IS NOT NULL AND z[2] <> 95),
counts AS (SELECT doc_id, lang, held_out, code, count(*) AS n FROM codes GROUP BY ALL),
ranked AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, code) - 1 AS place FROM counts WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code),
profiles AS (SELECT * FROM ranked WHERE place < 300),
own AS (SELECT * FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS place FROM counts) WHERE place < 300),
apart AS (SELECT own.doc_id, l.lang, count(*) AS size, sum(CASE WHEN p.place IS NULL THEN 300 ELSE abs(p.place - own.place) END)::BIGINT AS apart
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.code = own.code GROUP BY 1, 2),
best AS (SELECT doc_id, lang, 1 - apart::DOUBLE / (size * 300) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) AS k FROM apart)
SELECT docs.doc_id, docs.held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM docs LEFT JOIN best ON best.doc_id = docs.doc_id AND k = 1
"""

_OP11 = r"""
WITH seen AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM seen),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + least(len(ws), 10) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS s FROM b WHERE len(ws) > 0)),
hit AS (SELECT r, s, n, win FROM (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w))) SEMI JOIN w USING (n, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit JOIN w USING (n, win) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""

SQL = {"op2_mixing": _OP2, "op5_embedding_dedup": _OP5, "op7_warc": _OP7, "op8_language": _OP8, "op10_substrings": _OP10, "op11_winnowing": _OP11}
