"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinesight.llm.common import read_table
from dinesight.llm.hard_negatives import hard_negatives
from dinesight.llm.html_text import extract_pages
from dinesight.llm.license_scan import license_scan
from dinesight.llm.mixing import mix_sources
from dinesight.llm.ngram_join import jaccard_classes
from dinesight.llm.posting_lists import nearest_neighbours
from dinesight.llm.quality_rules import quality_rules
from dinesight.llm.rule_ensemble import quality_scores
from dinesight.llm.secret_scan import KINDS, LIVE_CHARACTERS, PLACEHOLDER, WIDE_OWNERS, WIDE_REPOSITORIES, secret_scan
from dinesight.llm.sentencepiece import encoded
from dinesight.llm.suffix_dedup import suffix_dedup
from dinesight.llm.toxicity import toxicity_scores
from dinesight.llm.whitening import whitened


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup, "op2_posting_lists": op2_posting_lists, "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules, "op5_rule_ensemble": op5_rule_ensemble, "op6_ngram_join": op6_ngram_join, "op7_toxicity": op7_toxicity,
    "op8_license_scan": op8_license_scan, "op9_html_text": op9_html_text, "op10_sentencepiece": op10_sentencepiece, "op11_hard_negatives": op11_hard_negatives, "op12_whitening": op12_whitening, "op13_secret_scan": op13_secret_scan,
}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _matches(rank: int) -> str:
    kind = KINDS[rank]
    p = kind.pattern.replace("'", "''")
    more = "AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')" if kind.mixed else ""
    return f"""SELECT * FROM (SELECT r, '{kind.name}' AS kind, {rank} AS rank, {str(kind.base).lower()} AS base, value,
        (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n
    FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i, unnest(regexp_extract_all(t, '{p}', {kind.group})) AS value
          FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d))) WHERE length(value) >= {kind.least} {more}"""


SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches(rank) for rank in range(len(KINDS)))}),
wide AS (SELECT value, count(DISTINCT owner) >= {WIDE_OWNERS} AND count(DISTINCT t) >= {WIDE_REPOSITORIES} AS wide FROM found JOIN d USING (r) GROUP BY value),
judged AS (SELECT found.*, wide, NOT wide AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '{PLACEHOLDER}')
                  AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live, kind || ':' || a || ':' || (a + n) AS span
           FROM found JOIN wide USING (value)),
per AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
               string_agg(span, ',' ORDER BY a, rank) FILTER (base) AS b, string_agg(span, ',' ORDER BY a, rank) FILTER (base OR live) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (wide) AS n_copied FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN per USING (r)""",
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 399)) AS s, n, h FROM d WHERE n >= 400),
win AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM w),
again AS (SELECT doc_id, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gap AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM again),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM gap),
span AS (SELECT doc_id, r, min(s) AS a, max(s) + 400 AS b FROM run GROUP BY doc_id, r),
cut AS (SELECT doc_id, r, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS p FROM span),
piece AS (SELECT c.doc_id, c.r, substr(d.h, 2 * p + 1, 2 * (a - p)) AS t FROM cut c JOIN d USING (doc_id)
          UNION ALL SELECT s.doc_id, 9e15, substr(d.h, 2 * max(s.b) + 1) FROM span s JOIN d USING (doc_id) GROUP BY s.doc_id, d.h),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY r) AS h FROM piece GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
           md5('mix-1' || coalesce(':' || doc_id, '')) AS o FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT source, total, 2.0::DOUBLE * total AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM src),
filled AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS before, sum(w) OVER r AS open FROM w
           WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT min_by((1.5::DOUBLE * (SELECT sum(total) FROM src) - before) / open, cap / w) AS v FROM filled
          WHERE cap >= (1.5::DOUBLE * (SELECT sum(total) FROM src) - before) / open * w),
t AS (SELECT source, total, least(cap, v * w) AS target FROM w, level),
n AS (SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, n.total, n.target, n.whole, n.target - n.whole * n.total AS need,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, total AS source_size, target,
       (size * (whole + CASE WHEN ahead < need AND 2 * ahead + size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op6_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.y), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n""",
}
