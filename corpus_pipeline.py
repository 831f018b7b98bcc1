"""The corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; all but the last return the columns of
``documents``. A stage works on all rows that it is given and reads nothing else but the labels and the vocabulary.

Defined cases, for all stages: columns beyond those of ``documents`` are left out, so none can clash; an empty table gives
an empty result; a null or empty text is a text of no words; long texts are read whole; null ids stay rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import bpe_codec, minhash_dedup, quality_gam, secret_scan, source_mix
from sluicework.llm.registry import VOCABULARY
from sluicework.llm.shared import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose predicted quality reaches the threshold; repeated rows and rows without text or id are judged alike."""
    docs = docs.select(COLUMNS)
    model = quality_gam.train(docs, table(spark, sf_dir, "labels").where(~quality_gam.held_out()))
    return quality_gam.score(docs, model, out="__score").where(F.col("__score") >= quality_gam.THRESHOLD).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id. Rows without words or id stay; of rows that share an id, one stays."""
    return minhash_dedup.one_of_each_group(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; n_chars follows where a text's length has changed. Null texts stay null, repeated rows change alike."""
    before = docs.select(COLUMNS).withColumn("__was", F.length("text"))
    cleaned = secret_scan.redacted(before)
    return cleaned.withColumn("n_chars", F.when(F.length("text") != F.col("__was"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mixture takes them: not at all, once or twice. A null source is a source of its own; rows of one id and size go together."""
    return source_mix.mixed(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256, n_tokens) of each row of the mixture, repeats too: its encoding, and the digest of what the ids decode to."""
    return bpe_codec.encode(docs, public_tokenizers.path(VOCABULARY)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("secret scan", secrets), ("source mix", mix), ("bpe encoding and decoding", encode)]

#: SQL can't express the classifier, the near-duplicates or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else stash(docs, f"stage{k}"), sf_dir)
    return docs
