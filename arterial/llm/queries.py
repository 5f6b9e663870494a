"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from arterial.llm import decontaminate, exact_dedup, jaccard, language, license, packing, pii, quality, substring, wavelet
from arterial.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language.held_out(5, 0)
    net = quality.learn(docs, labels.filter(~out))
    return quality.score(docs, net).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), jaccard.Rule(n=3, num=90, den=100))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_digest(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"), pii.learn())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(3, 1)
    teach = F.col("doc_id").isNotNull() & ~out
    profiles = language.learn_profiles(docs.filter(teach))
    found = language.identify(docs, profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_substring_dedup, op4_pii, op5_license_scan, op6_exact_dedup, op7_wavelet_tokens, op8_decontamination, op9_best_fit_packing, op10_language_id)}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": op5_sql(), "op6_exact_dedup": OP6_SQL}


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_sql() -> str:
    templates = ", ".join(f"({n}, '{t.license}', '{t.key}', {t.place}, '{' '.join(t.words)}')" for n, t in enumerate(license.TEMPLATES))
    separator = license.SEPARATOR.replace("'", "''")
    return f"""
WITH template(t, license, key, place, text) AS (VALUES {templates}),
tword AS MATERIALIZED (SELECT t, w, count(*) AS tf FROM (SELECT t, unnest(string_split(text, ' ')) AS w FROM template) GROUP BY t, w),
row AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, url, list_filter(regexp_split_to_array(lower(coalesce(html, '')), '{separator}'), lambda x: x <> '') AS words FROM pages),
total AS MATERIALIZED (SELECT count(*) AS n FROM row),
idf AS MATERIALIZED (SELECT w, 1 + ln((1.0 + n) / (1.0 + df)) AS idf FROM (SELECT w, count(*) AS df FROM (SELECT DISTINCT r, unnest(words) AS w FROM row) GROUP BY w), total),
weight AS MATERIALIZED (SELECT t, w, tf * coalesce(idf, 1 + ln(1.0 + n)) AS x FROM tword CROSS JOIN total LEFT JOIN idf USING (w)),
length AS MATERIALIZED (SELECT t, sqrt(sum(x * x)) AS length FROM weight GROUP BY t),
place AS MATERIALIZED (SELECT r, w, i - 1 AS i FROM (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM row) WHERE w IN (SELECT key FROM template)),
laid AS MATERIALIZED (SELECT p.r, t, i - place AS start, row.words[greatest(i - place, 0) + 1 : i - place + len(string_split(text, ' '))] AS span
  FROM place p JOIN template ON key = w JOIN row ON row.r = p.r),
word AS MATERIALIZED (SELECT r, t, start, w, count(*) AS tf FROM (SELECT r, t, start, unnest(span) AS w FROM laid) GROUP BY ALL),
scored AS (SELECT word.r, word.t, start, round(sum(coalesce(word.tf * idf * x, 0)) / any_value(length) / sqrt(sum(pow(word.tf * idf, 2))), 6) AS score
  FROM word JOIN idf USING (w) JOIN length ON length.t = word.t LEFT JOIN weight ON weight.t = word.t AND weight.w = word.w GROUP BY word.r, word.t, start),
top AS (SELECT r, license, score FROM scored JOIN template USING (t) WHERE score >= {license.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
bare AS (SELECT r, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS p FROM row),
file AS MATERIALIZED (SELECT r, page_id, license, score, path, regexp_replace(path, '/[^/]*$', '') AS home
  FROM row LEFT JOIN top USING (r) JOIN (SELECT r, CASE WHEN p LIKE '%/%' THEN p ELSE p || '/' END AS path FROM bare) USING (r)),
vote AS (SELECT home AS dir, license, count(*) AS n, bool_or(regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^(licen[cs]e|copying|notice)(\\.|$)')) AS named
  FROM file WHERE license IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
dirs AS MATERIALIZED (SELECT dir, license FROM vote QUALIFY row_number() OVER (PARTITION BY dir ORDER BY named DESC, n DESC, license) = 1),
near AS (SELECT f.r, d.dir, d.license FROM file f JOIN dirs d ON starts_with(f.home || '/', d.dir || '/')
  WHERE f.license IS NULL QUALIFY row_number() OVER (PARTITION BY f.r ORDER BY length(d.dir) DESC) = 1)
SELECT page_id, path, file.license, score, near.license AS inherited, near.dir AS inherited_from FROM file LEFT JOIN near USING (r)
"""
