"""Sampling and splitting: seeded permutations, stratified interleaving, holdout sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .positions import numbered

#: The stratum of rows that lack the field.
MISSING = "_missing_"
SENTENCE_END = r"(?<=[.!?])\s+"


def content_seed(text: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A portable random order: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``pos``: a permutation that depends on the seed and the keys only."""
    return numbered(df.withColumn("__d", draw(F.col(key), seed)), "__d", key).drop("__d")


def interleaved(df: DataFrame, key: str, field: str | None, seed: int = 42) -> DataFrame:
    """``df`` with ``pos``: shuffled within strata, one of each stratum in turn, strata in the order of their first key.

    Without a field the order of keys remains. Rows without the field form a stratum of their own; none is lost.
    """
    if field is None:
        return numbered(df, key)
    rows = df.withColumn("__s", F.coalesce(F.col(field).cast("string"), F.lit(MISSING))).withColumn("__d", draw(F.col(key), seed))
    rows = numbered(rows, "__s", "__d", key, name="__g")  # a hot stratum is spread over ranges, not sorted in one task
    first = rows.groupBy("__s").agg(F.min(key).alias("__f"), F.min("__g").alias("__start"))
    rows = rows.join(first, "__s").withColumn("__r", F.col("__g") - F.col("__start"))
    return numbered(rows, "__r", "__f").drop("__s", "__d", "__g", "__start", "__r", "__f")


def holdout(df: DataFrame, chunk: str, order: str, ratio: float = 0.2) -> DataFrame:
    """``df`` with ``is_holdout``: the last max(1, floor(n * ratio)) rows of each chunk; none if ratio <= 0."""
    if ratio <= 0:
        return df.withColumn("is_holdout", F.lit(False))
    n = F.count("*").over(Window.partitionBy(chunk))
    place = F.row_number().over(Window.partitionBy(chunk).orderBy(order))
    return df.withColumn("is_holdout", place > n - F.greatest(F.lit(1), F.floor(n * ratio)))


def holdout_by_position(chunks: DataFrame, size: int, ratio: float = 0.2) -> DataFrame:
    """holdout() for rows that carry chunk_index and pos_in_chunk: all chunks but the last have ``size`` rows, so nothing is shuffled."""
    if ratio <= 0:
        return chunks.withColumn("is_holdout", F.lit(False))
    last = chunks.agg(F.max(F.struct("chunk_index", "pos_in_chunk")).alias("__last"))
    n = F.when(F.col("chunk_index") < F.col("__last.chunk_index"), F.lit(size)).otherwise(F.col("__last.pos_in_chunk") + 1)
    held = F.col("pos_in_chunk") >= n - F.greatest(F.lit(1), F.floor(n * ratio))
    return chunks.crossJoin(F.broadcast(last)).withColumn("is_holdout", held).drop("__last")


def holdout_sentences(text: Column, ratio: float = 0.2) -> tuple[Column, Column, Column]:
    """(sentences, kept text, held-out text): the last sentences of a text; one alone is not split."""
    parts = F.split(F.trim(text), SENTENCE_END)
    n = F.size(parts)
    held = F.when((n > 1) & F.lit(ratio > 0), F.greatest(F.lit(1), F.floor(n * ratio).cast("int"))).otherwise(0)
    return n.cast("long"), F.array_join(F.slice(parts, F.lit(1), n - held), " "), F.array_join(F.slice(parts, n - held + 1, held), " ")


def first_of_chunk(df: DataFrame, chunk: str, order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each chunk."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(chunk).orderBy(order))).where(F.col("__r") <= n).drop("__r")
