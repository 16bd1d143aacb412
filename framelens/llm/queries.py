"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import byte_bpe, compression_quality, exact_dedup, license_scan, merkle, mixing, ngram_join, quality, secret_scan, sharding, suffix_dedup, token_align, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), power=0.7).select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(_table(spark, sf_dir, "documents"), length=100)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "key string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), listed)


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_align.align(_table(spark, sf_dir, "documents"), a, b)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
e AS (SELECT *, sha256(bare) AS text_sha256,
  first_value(doc_id) OVER (PARTITION BY bare ORDER BY cp DESC, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY bare) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM e
"""

_NUMBER = "('0x' || substr(md5({}), 1, 15))::BIGINT"

OP5_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, 0.7) AS w FROM n),
r AS (SELECT source, round((SELECT sum(n) FROM w) * w / (SELECT sum(w) FROM w) / n, 9) AS rate FROM w),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM r, range(0, 200) t(k)),
cdf AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= {_NUMBER.format("'23:' || d.doc_id")} / 1152921504606846976.0) AS n_copies FROM documents d),
copies AS (SELECT doc_id, source, text, n_copies, unnest(range(0, n_copies)) AS copy FROM drawn)
SELECT doc_id, source, copy::INT AS copy, n_copies::INT AS n_copies, {_NUMBER.format("'23:at:' || doc_id || ':' || copy")} AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256 FROM copies
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op7_sql() -> str:
    grams = ", ".join(f"({i}, {_quoted(name)}, [{', '.join(map(_quoted, g))}])" for i, name, g in license_scan.template_grams())
    return rf"""
WITH t(i, name, grams) AS (VALUES {grams}),
units AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '{license_scan.BREAK}')) AS unit FROM documents WHERE contains(text, chr(10)))
    WHERE len(list_filter(string_split(unit, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) > 1
  UNION ALL SELECT doc_id, 'whole', text FROM documents WHERE contains(text, chr(10))),
words AS (SELECT doc_id, kind, list_filter(regexp_split_to_array(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM units),
small AS (SELECT row_number() OVER () AS unit_id, * FROM words WHERE len(w) > 1),
sets AS (SELECT unit_id, doc_id, kind, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS g FROM small),
scored AS (SELECT unit_id, doc_id, kind, i, name, 2.0::DOUBLE * len(list_intersect(t.grams, g)) / (len(t.grams) + len(g)) AS dice FROM sets, t WHERE len(t.grams) * 5 <= len(g) * 7.5 + 0.001 AND len(t.grams) * 7.5 + 0.001 >= len(g) * 5),
best AS (SELECT * FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY dice DESC, i) = 1),
docs AS (SELECT doc_id, arg_min(name, struct_pack(d := -dice, i := i)) AS licence, round(max(dice), 6) AS dice, count(*) FILTER (kind = 'line') AS n_matches, count(*) FILTER (kind = 'paragraph') AS n_paragraphs,
  coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind <> 'whole'), '') AS licences, bool_or(kind = 'whole') AS whole FROM best GROUP BY doc_id)
SELECT d.doc_id, licence, dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(n_paragraphs, 0)::BIGINT AS n_paragraphs, coalesce(licences, '') AS licences, coalesce(whole, false) AS whole FROM documents d LEFT JOIN docs USING (doc_id)
"""


def _op10_sql() -> str:
    rules = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in url_filter.RULES)
    listed = ", ".join(f"({_quoted(x)})" for x in url_filter.LISTED)
    return rf"""
WITH rules(verdict, h, p) AS (VALUES {rules}), listed(key) AS (VALUES {listed}),
pg AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM pg),
flags AS (SELECT host, EXISTS (SELECT 1 FROM listed WHERE host = key OR ends_with(host, '.' || key)) AS listed FROM hosts),
fit AS (SELECT DISTINCT host, path, (SELECT max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM (SELECT DISTINCT host, path FROM pg))
SELECT page_id, a.host, a.path, r.rule AS rule, coalesce(r.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM pg a JOIN flags f ON a.host = f.host JOIN fit ON fit.host = a.host AND fit.path = a.path
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_byte_bpe, op3_sharding, op4_quality_rules, op5_mixing, op6_suffix_dedup, op7_license_scan, op8_secret_scan, op9_ngram_join, op10_url_filter, op11_token_align, op12_quality_classifier, op13_merkle_manifest)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op7_license_scan": _op7_sql(),
    "op10_url_filter": _op10_sql(),
}
