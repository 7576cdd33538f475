"""The operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_topk, license, lsh_forest, mixing, sharding, simhash, substring, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark, sf_dir):
    return substring.dedup_digests(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.document_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_license(spark, sf_dir):
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lsh_forest(spark, sf_dir):
    return lsh_forest.nearest(table(spark, sf_dir, "embeddings"))


def op7_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_exact_topk(spark, sf_dir):
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring, op2_mixing, op3_bpe, op4_license, op5_toxicity, op6_lsh_forest, op7_warc, op8_exact_topk, op9_simhash, op10_sharding)}

#: Words of a text, as the operators count them.
_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

_OP2 = rf"""
WITH RECURSIVE r AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || nth) AS key FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS nth FROM (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents))
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM r GROUP BY source
), weighed AS (
  SELECT *, (source_rank - 1) % 3 + 1 AS w FROM named
), rested AS (
  SELECT *, sum(source_size) OVER () AS budget,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 6 // w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY source_size * 6 // w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM weighed
), filled AS (
  SELECT *, 3 * source_size * rest_w <= w * rest AS full_ FROM rested
), shared AS (
  SELECT *, budget - sum(CASE WHEN full_ THEN 3 * source_size ELSE 0 END) OVER () AS free, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS free_w FROM filled
), goal AS (
  SELECT source, source_rank, source_size, budget, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE (w * free)::DOUBLE / free_w::DOUBLE END AS target FROM shared
), queued AS (
  SELECT r.*, g.source_rank, g.source_size, g.budget, g.target,
    sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT q.*, c.copy, CASE WHEN target > 0 THEN (copy * source_size + upto)::DOUBLE / target END AS finish FROM queued q, (VALUES (0), (1), (2)) c(copy)
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, key, doc_id, size, nth, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served FROM copies WHERE finish IS NOT NULL
), whole AS (
  SELECT doc_id, source, size, nth, count(*) AS n FROM served WHERE served <= budget GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (q.size * coalesce(n, 0))::BIGINT AS taken
FROM queued q LEFT JOIN whole h ON q.doc_id IS NOT DISTINCT FROM h.doc_id AND q.source IS NOT DISTINCT FROM h.source AND q.size = h.size AND q.nth = h.nth
"""

_OP1 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), f AS (
  SELECT gram, min(doc_id) AS first FROM g GROUP BY gram
), gone AS (
  SELECT DISTINCT doc_id, i + j AS word_at FROM (SELECT g.doc_id, i FROM g JOIN f USING (gram) WHERE first < g.doc_id), range(13) r(j)
), marks AS (
  SELECT doc_id, list(word_at) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, words, CASE WHEN gone IS NULL THEN words ELSE (
    SELECT coalesce(list(words[i] ORDER BY i), []) FROM range(1, len(words) + 1) s(i) WHERE NOT list_contains(gone, i)) END AS rest
  FROM w LEFT JOIN marks USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(rest))::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

_OP7 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p
), e AS (
  SELECT page_id, payload_bytes, h,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32 + 1, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first
  FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM e
"""

_OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL = {"op1_substring": _OP1, "op2_mixing": _OP2, "op7_warc": _OP7, "op8_exact_topk": _OP8}
