"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_topk, language_id, media_copies, minhash_dedup, quality_gam, secret_scan, source_mix, token_counts, url_filter
from .shared import table

VOCABULARY = "byte_bpe_50k.json"


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixture(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media: every vector of ``embeddings`` is rendered as a picture, and those are the media column."""
    media = media_copies.rendered(table(spark, sf_dir, "embeddings"))
    return media_copies.copies(media, "vec_id", "image").withColumnRenamed("id", "vec_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


_ALL = (op1_quality_gam, op2_minhash_dedup, op3_url_filter, op4_source_mix, op5_language_id, op6_bpe_codec, op7_exact_topk, op8_secret_scan, op9_media_copies, op10_token_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": minhash_dedup.near_duplicates_sql(), "op8_secret_scan": secret_scan.scan_sql(), "op3_url_filter": url_filter.judge_sql(), "op4_source_mix": source_mix.mixture_sql(), "op7_exact_topk": exact_topk.nearest_sql()}
