"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import ann, fingerprint, language_id, line_dedup, ngram_join, packing, sampling, token_counts, toxicity, url_filter


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(spark, table(spark, sf_dir, "documents"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(spark, docs, least_words=line_dedup.ALL_LINES)
    return found.select("doc_id", F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"), "text")


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_digests(spark, table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.sql()}
