"""The corpus operators on the given tables, one query each, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    exact_dedup,
    kd_search,
    langid,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    secret_scan,
    spelling,
    token_counts,
    token_files,
    whitening,
)
from corpusloom.session import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_retrieval_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_token_files(spark, sf_dir):
    folder = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_kd_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", kd_search.quantised(F.col("embedding")).alias("vector"))
    return kd_search.top_k(vectors, F.col("vec_id") % 20 == 0)


ORACLES["op7_kd_search"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op8_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_dropped", kept)


ORACLES["op8_line_dedup"] = """
WITH split AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), frequent AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id < f.last_doc, false) AS dropped
  FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_secret_scan(spark, sf_dir):
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secret_scan.summaries(versions, secret_scan.Ledger(spark))
    return found.select(
        F.col("path").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )


ORACLES["op9_secret_scan"] = r"""
WITH kinds(kind, ord, pattern, part, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0, 1)
), cuts AS (
  SELECT doc_id, 'assign' AS kind,
    string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS parts
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 'access', string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0)
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 'hex', string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0)
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  UNION ALL
  SELECT doc_id, 'pem', string_split_regex(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0), regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0)
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), rows AS (
  SELECT doc_id, kind, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(parts) AS part
  FROM cuts WHERE len(hits) > 0
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM rows
), spans AS (
  SELECT p.doc_id, p.kind, k.ord, stop - length(hit) AS start, stop
  FROM placed p JOIN kinds k ON p.kind = k.kind WHERE length(p.part) >= k.least
), told AS (
  SELECT doc_id,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign,
    count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id
"""


@query
def op10_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
