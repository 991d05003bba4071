"""The registered query of each corpus operator, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontam, language, neardup, packing, pii, suffix, tokens, toxicity, urls
from .common import fold, small_batches, table

#: op9 edits each document: a word in the middle goes, a phrase comes in at a quarter, one is replaced at three quarters, one is added.
EDITS = """array(
  named_struct('start', cast(n div 2 as bigint), 'end', cast(n div 2 + 7 as bigint), 'text', ''),
  named_struct('start', cast(n div 4 as bigint), 'end', cast(n div 4 as bigint), 'text', concat(' revision ', doc_id, ' of')),
  named_struct('start', cast(3 * n div 4 as bigint), 'end', cast(3 * n div 4 + 3 as bigint), 'text', "'ll 2024"),
  named_struct('start', cast(n + 99 as bigint), 'end', cast(n + 99 as bigint), 'text', ' The end.'))"""
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels")
    return toxicity.learn(table(spark, sf_dir, "documents"), labels.where(fold(F.col("doc_id"), 3) != 1))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(spark, sf_dir))
    return scored.select(F.col("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.digest(pii.sanitise_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return audio.text_as_audio(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    filters = language.learn(docs.where(~held))
    return language.identify(docs, filters).withColumn("held_out", held)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", F.transform("hits", lambda h: h["item"]).alias("items"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    edited = tokens.apply_edits(tokens.count_tokens(docs.withColumn("edits", F.expr(EDITS))))
    return edited.select("doc_id", "tokens_before", "n_tokens", "n_edits", "encoded_chars", F.size("leaf_chars").alias("n_leaves"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT s.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fit f ON s.n = f.n AND f.k = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_audio_features, op4_language_id, op5_decontamination, op6_url_filter, op7_minhash_dedup, op8_suffix_dedup, op9_token_counts, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL}
