"""Registered queries of the operators, with production parameters, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import quality, toxicity
from pricelens.llm.ann import nearest
from pricelens.llm.byte_bpe import encode_documents
from pricelens.llm.common import table
from pricelens.llm.exact_dedup import exact_duplicates
from pricelens.llm.packing import pack
from pricelens.llm.periodic import collapse_documents
from pricelens.llm.prefix_trie import prefix_trie
from pricelens.llm.secrets import find_secrets
from pricelens.llm.simhash import near_duplicates
from pricelens.llm.token_counts import count_tokens
from pricelens.llm.token_store import read_store, write_store
from pricelens.llm.url_filter import RULES, judge


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(*write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_documents(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_byte_bpe, op2_packing, op3_quality, op4_exact_dedup, op5_token_counts, op6_url_filter, op7_simhash, op8_token_store, op9_toxicity, op10_ann,
        op11_secrets, op12_periodic, op13_prefix_trie,
    )
}

#: crc32 of the decimal form of {id}, bit by bit, as DuckDB SQL.
_CRC = """xor(list_reduce(list_transform(string_split({id}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, c:
  list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, c)), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM plain""",
    "op6_url_filter": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, url, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
urls AS (
  SELECT page_id, html, p.scheme AS scheme, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path, p.query AS query,
         CASE WHEN contains(url, '://') THEN concat(p.scheme, '://', translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p.path, p.query) END AS node
  FROM parts),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (
  SELECT scheme, host, path, node, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''>\s]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1)))) AS raw
  FROM urls WHERE node IS NOT NULL),
targets AS (
  SELECT node, CASE WHEN raw = '' THEN NULL WHEN contains(raw, '://') THEN replace(raw, '&amp;', '&') WHEN starts_with(raw, '//') THEN scheme || ':' || replace(raw, '&amp;', '&')
                    WHEN starts_with(raw, '/') THEN scheme || '://' || host || replace(raw, '&amp;', '&')
                    ELSE scheme || '://' || host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || replace(raw, '&amp;', '&') END AS target FROM tags),
split AS (SELECT node, target, regexp_extract(target, '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', ['scheme', 'host', 'path', 'query']) AS p FROM targets WHERE target IS NOT NULL),
edges AS (SELECT DISTINCT node AS a, concat(p.scheme, '://', translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p.path, p.query) AS b FROM split),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
ends AS (SELECT DISTINCT a AS node, regexp_extract(a, '(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)', ['scheme', 'host', 'path', 'query']) AS p FROM both_ways),
blocked AS (
  SELECT node FROM (SELECT node, first(r.verdict ORDER BY length(r.host || r.path) DESC) AS verdict FROM ends JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY node) WHERE verdict = 'block'),
reach AS (SELECT node FROM blocked UNION SELECT b FROM reach JOIN both_ways ON a = node),
found AS (
  SELECT u.page_id, u.host, u.path, u.node, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM found WHERE n = 1""",
    "op12_periodic": f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, {_CRC.format(id="doc_id")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM split),
placed AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM sized),
texts AS (SELECT r, doc_id, n, CASE WHEN g IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM placed),
words AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
per AS (SELECT r, count(*) AS n_runs, first([s, len, q] ORDER BY len DESC, s, q) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS rest FROM words w ANTI JOIN dropped d ON w.r = d.r AND w.i = d.i GROUP BY w.r)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2] // best[3])::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM texts t LEFT JOIN per USING (r) LEFT JOIN kept USING (r)""",
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format(id="conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
chosen AS (
  SELECT c.conv_id, t.role, t.text, 0 AS part, t.i FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.i FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM chosen),
hashed AS (SELECT *, sha256(length(role) || ':' || role || text) AS e FROM rebuilt),
paths AS (SELECT conv_id, depth, length(text) AS chars, string_agg(e, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM hashed),
prefixes AS (SELECT conv_id, depth, chars, k FROM paths UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
longest AS (SELECT conv_id, max(depth) AS last FROM prefixes GROUP BY conv_id),
members AS (SELECT p.*, min(p.conv_id) OVER (PARTITION BY depth, k) AS owner, l.last FROM prefixes p JOIN longest l USING (conv_id)),
nodes AS (SELECT owner, depth, count(*) AS n_convs, min(chars) AS chars, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last) AS ids FROM members GROUP BY owner, depth),
up AS (SELECT m.owner, m.depth, q.owner AS parent FROM members m JOIN members q ON q.conv_id = m.conv_id AND q.depth = m.depth - 1 WHERE m.conv_id = m.owner),
children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY 1, 2),
whole AS (SELECT n.*, u.parent, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN up u USING (owner, depth) LEFT JOIN children c USING (owner, depth)),
below AS (
  SELECT m.owner, m.depth, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved
  FROM whole w JOIN members m ON m.conv_id = w.owner AND m.depth <= w.depth GROUP BY 1, 2)
SELECT w.owner AS conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
       sha256(coalesce(w.ids, '')) AS ends_sha256
FROM whole w JOIN below b USING (owner, depth)""",
}
