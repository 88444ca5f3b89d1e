"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import bpe, exact_dedup, language_id, license_scan, mixing, simhash, suffix_dedup, token_counts, token_store, topk_search

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "doc_id")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(token_store.stored_tokens(_documents(spark, sf_dir), vocabulary(WORD_VOCABULARY)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(license_scan.summarised(license_scan.scan_licenses(_documents(spark, sf_dir))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(token_counts.count_tokens(_documents(spark, sf_dir), vocabulary(WORD_VOCABULARY)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id")) != 0))
    found = _renamed(language_id.predict(docs, model))
    held_out = F.coalesce(language_id.fold(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_languages")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(bpe.round_trip(_documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(mixing.mix_sizes(_documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(simhash.near_duplicates(_documents(spark, sf_dir)))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(exact_dedup.exact_duplicates(_documents(spark, sf_dir)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed(suffix_dedup.remove_repeats(_documents(spark, sf_dir)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_store, op2_license_scan, op3_token_counts, op4_language_id, op5_bpe, op6_mixing, op7_simhash, op8_topk, op9_exact_dedup, op10_suffix_dedup, pipeline)}

OP6_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), drawn AS (
  SELECT *, (CAST(('0x' || substr(md5('mix:' || k || ':' || coalesce(source, '') || ':' || CAST(size AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS documents FROM drawn GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 3 AS cap FROM by_source
), filled AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS share,
    row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST) AS place
  FROM weighed
), rated AS (
  SELECT *, arg_min(share, place) FILTER (WHERE CAST(cap AS DOUBLE) / weight > share) OVER () AS rate FROM filled
), plan AS (
  SELECT source AS s, source_size, documents, coalesce(least(CAST(cap AS DOUBLE), rate * weight), CAST(cap AS DOUBLE)) AS target FROM rated
), ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS share,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS wanted FROM plan
), keyed AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.wanted, p.s,
         CASE WHEN p.share > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / ((p.share / (1.0::DOUBLE - p.share)) * ((CAST(size AS DOUBLE) * CAST(p.documents AS DOUBLE) / CAST(p.source_size AS DOUBLE)) * 1.0::DOUBLE)) END AS q
  FROM drawn d JOIN ratios p ON d.source IS NOT DISTINCT FROM p.s
), units AS (
  SELECT s, q, k, wanted, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (PARTITION BY s ORDER BY q, k) AS rank FROM keyed WHERE q IS NOT NULL GROUP BY s, q, k, wanted
), walk AS (
  SELECT s, 0::BIGINT AS rank, 0::BIGINT AS got, false AS chosen FROM ratios
  UNION ALL
  SELECT w.s, u.rank, w.got + CASE WHEN w.got + u.words <= u.wanted THEN u.words ELSE 0 END, w.got + u.words <= u.wanted
  FROM walk w JOIN units u ON u.s IS NOT DISTINCT FROM w.s AND u.rank = w.rank + 1
), gaps AS (
  SELECT s, max(got) AS got FROM walk GROUP BY s
), judged AS (
  SELECT u.*, w.chosen, u.wanted - g.got AS gap FROM units u JOIN walk w ON u.s IS NOT DISTINCT FROM w.s AND u.rank = w.rank JOIN gaps g ON u.s IS NOT DISTINCT FROM g.s
), last AS (
  SELECT s, min(struct_pack(off := abs(words - gap), q := q, k := k)) AS best FROM judged WHERE NOT chosen AND abs(words - gap) < abs(gap) GROUP BY s
), decided AS (
  SELECT j.s, j.q, j.k, j.chosen OR coalesce(l.best.q = j.q AND l.best.k = j.k, false) AS chosen FROM judged j LEFT JOIN last l ON j.s IS NOT DISTINCT FROM l.s
)
SELECT d.doc_id, d.size, d.source_size, d.target, CAST((d.whole + coalesce(CAST(c.chosen AS INTEGER), 0)) * d.size AS BIGINT) AS taken
FROM keyed d LEFT JOIN decided c ON d.s IS NOT DISTINCT FROM c.s AND d.q = c.q AND d.k = c.k
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9_SQL = """
SELECT doc_id,
  max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS p, unnest(list_transform(range(0, len(h) // 2), lambda i: substr(h, 2 * i + 1, 100))) AS s FROM d
), least_doc AS (SELECT s, min(doc_id) AS first_doc FROM g WHERE len(s) = 100 GROUP BY s
), marked AS (SELECT g.doc_id, g.p, substr(g.s, 1, 2) AS byte, coalesce(l.first_doc < g.doc_id, false) AS start FROM g LEFT JOIN least_doc l ON g.s = l.s
), gone AS (SELECT *, max(CASE WHEN start THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM marked
), spans AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM gone
), sums AS (SELECT doc_id, count(*) AS n_bytes, CAST(count_if(gone) AS BIGINT) AS n_removed, CAST(count_if(opens) AS BIGINT) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""

ORACLE_SQL = {"op6_mixing": OP6_SQL, "op8_topk": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
