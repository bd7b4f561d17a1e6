"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from sparkloom.llm import decontamination, mixing, ngram_join, quality_knn, quality_rules, suffix_dedup, token_counts, toxicity, url_filter, warc
from sparkloom.llm._common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_ngram_join, op3_suffix_dedup, op4_decontamination, op5_warc_histories, op6_source_mix, op7_token_counts, op8_url_filter, op9_quality_rules, op10_quality_knn)}


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT rid, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) k WHERE len(w) >= k.n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
got AS (SELECT rid, list_sort(list(DISTINCT item_id) FILTER (WHERE item_id IS NOT NULL)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN got USING (rid)
"""

#: Five hexadecimal digits of the SHA-1 are four letters in base 32.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, text, length(text) AS chars,
 CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 12) AS BIGINT) AS DOUBLE) AS digits FROM documents),
k AS (SELECT doc_id, source, size, -ln((digits + 0.5) / 281474976710656.0) / CASE WHEN coalesce(chars, 0) = 0 THEN 0.1
 ELSE greatest(0.1, 1.0 - 4.0 * ((chars - length(regexp_replace(text, '[#*$%&|<>!]+', '', 'g'))) / chars)) END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap,
 CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0 AS budget FROM s),
a AS (SELECT *, budget - coalesce(sum(cap) OVER o, 0.0) AS left_over, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0) AS sharing FROM w
 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, left_over * weight >= cap * sharing AS capped FROM a),
f AS (SELECT left_over AS l, sharing AS h FROM c WHERE NOT capped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (SELECT l FROM f) * weight / (SELECT h FROM f) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS part FROM e),
u AS (SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.part,
 coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(part - before, 0)) AS BIGINT) AS taken FROM u
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op5_warc_histories": OP5_SQL, "op6_source_mix": OP6_SQL}
