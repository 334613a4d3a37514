"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, html, kdtree, langid, packing, phrases, quality, simhash, tokens, urlgraph, warc, whitening
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.document_fingerprints(read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.sharding(read(spark, sf_dir, "documents"), 40, ["lang", "source", "n_chars"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_decontamination, op2_url_filter, op3_quality, op4_warc, op5_fingerprints, op6_language, op7_simhash, op8_token_counts, op9_packing, op10_html, op11_sharding, op12_alignment, op13_whitening)
    return {f.__name__: f for f in found}


_OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, list_slice(w, i, i + least(8, len(w)) - 1) AS k
  FROM items, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM windows
), stretches AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT s.doc_id, s.i, s.n, v.item_id FROM stretches s JOIN windows v ON s.n = v.n AND s.k = v.k
), counts AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words d LEFT JOIN counts USING (doc_id) LEFT JOIN places USING (doc_id)
"""

#: Ranks after 250 rounds: what they then still lack, 0.85 to the power of 250, is beyond a double.
_OP2 = r"""
WITH RECURSIVE judged_urls AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(ruled, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT host, path, ruled, rhost || rpath AS rule, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, ruled, rhost || rpath) AS k
  FROM (SELECT DISTINCT host, path FROM judged_urls) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), base AS (
  SELECT u.page_id, u.html, u.host, u.path, f.rule, f.ruled FROM judged_urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path AND f.k = 1
), seeds AS (
  SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM base WHERE host <> '' GROUP BY host
), shares AS (
  SELECT 't' AS kind, host, good / (SELECT sum(good) FROM seeds) AS s FROM seeds WHERE good > 0
  UNION ALL SELECT 'd', host, bad / (SELECT sum(bad) FROM seeds) FROM seeds WHERE bad > 0
), refs AS (
  SELECT host AS src, regexp_extract(html, '(?is)<base(?:\s[^>]*)?\shref\s*=\s*["'']?\s*([^"''\s<>]+)', 1) AS base,
    unnest(regexp_extract_all(html, '(?is)<(?:a|area)(?:\s[^>]*)?\shref\s*=\s*["'']?\s*([^"''\s<>]+)', 1)) AS ref FROM base WHERE host <> ''
), ends AS (
  SELECT src, CASE WHEN regexp_matches(ref, '(?is)^(?:https?:)?//([^/?#]*)') THEN regexp_extract(ref, '(?is)^(?:https?:)?//([^/?#]*)', 1)
    WHEN NOT regexp_matches(ref, '(?is)^[a-z][a-z0-9+.-]*:') THEN regexp_extract(base, '(?is)^(?:https?:)?//([^/?#]*)', 1) END AS raw FROM refs
), links AS (
  SELECT src, dst, count(*) AS w FROM (SELECT src, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM ends) WHERE dst <> '' AND src <> dst GROUP BY src, dst
), edges AS (
  SELECT 't' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM links
  UNION ALL SELECT 'd', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM links
), walk(k, kind, host, rank) AS (
  SELECT 0, kind, host, CAST(s AS DOUBLE) FROM shares
  UNION ALL
  SELECT k + 1, kind, host, sum(rank) FROM (
    SELECT w.k, w.kind, e.dst AS host, 0.85 * w.rank * e.share AS rank FROM walk w JOIN edges e ON w.kind = e.kind AND w.host = e.src
    UNION ALL SELECT n.k, s.kind, s.host, 0.15 * s.s FROM shares s, (SELECT DISTINCT k FROM walk) n
  ) WHERE k < 250 GROUP BY k, kind, host
), ranks AS (
  SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS rank FROM walk WHERE k = 250
), sides AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS distrust FROM ranks GROUP BY host
)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(b.ruled, CASE WHEN r.distrust > 0 AND round(r.distrust, 12) >= round(r.trust, 12) THEN 'block' ELSE 'allow' END) AS verdict
FROM base b LEFT JOIN sides r USING (host)
"""

_OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), f AS (
  SELECT s, min(page_id) AS first FROM p GROUP BY s
)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(s, CAST(k // 8 * 10 + 1 AS BIGINT), 10)) :: BIGINT >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (s)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op2_url_filter": _OP2, "op4_warc": _OP4}
