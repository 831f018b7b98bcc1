"""Chunking: rows, characters, paragraphs and sentences."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import numbered

SENTENCE = re.compile(r"(?<=[.!?])\s+")


def row_chunks(df: DataFrame, *order: Column | str, size: int = 50) -> DataFrame:
    """``df`` with chunk_index and pos_in_chunk."""
    if size < 1:
        raise ValueError("size must be positive")
    rows = numbered(df, *order, name="__pos")
    return rows.withColumn("chunk_index", F.floor(F.col("__pos") / size)).withColumn("pos_in_chunk", F.col("__pos") % size).drop("__pos")


def char_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """A row for each window of ``size`` characters that isn't blank: chunk_index, chunk."""
    last = F.floor((F.length(text) - 1) / size)
    rows = df.where(F.length(text) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("chunk", F.substring(F.col(text), (F.col("chunk_index") * size + 1).cast("int"), F.lit(size)))
    return rows.where(F.trim("chunk") != "")


def paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size``; longer ones by sentences, longer sentences by windows; chunks repeat the last
    ``overlap`` characters of the one before."""
    out: list[str] = []
    open_ = ""

    def flush() -> str:
        nonlocal open_
        if open_.strip():
            out.append(open_)
        tail = open_[-overlap:] if overlap else ""
        open_ = ""
        return tail

    def add(piece: str, joint: str) -> None:
        nonlocal open_
        if open_ and len(open_) + len(joint) + len(piece) > size:
            tail = flush()
            open_ = tail if len(tail) + len(joint) + len(piece) <= size else ""
        open_ = open_ + joint + piece if open_ else piece

    for paragraph in filter(str.strip, re.split(r"\n\n+", text)):
        if len(paragraph) <= size:
            add(paragraph, "\n\n")
            continue
        for sentence in SENTENCE.split(paragraph):
            if len(sentence) <= size:
                add(sentence, " ")
            else:
                flush()
                out.extend(w for k in range(0, len(sentence), max(1, size - overlap)) if (w := sentence[k : k + size]).strip())
    flush()
    return out


def sentence_pieces(text: str, shortest: int = 12) -> list[str]:
    """Sentences with their delimiters; those under ``shortest`` characters go with what follows."""
    pieces, held = [], ""
    for part in filter(None, re.split(r"(?<=\. )|(?<=! )|(?<=\? )|(?<=\n)", text)):
        held += part
        if len(held) >= shortest:
            pieces.append(held)
            held = ""
    return [*pieces, held] if held else pieces


def sentences(text: str, size: int, overlap: int = 0, least: int = 1) -> list[tuple[str, int, int]]:
    """(chunk, start, end): whole sentences, each chunk shorter than ``size`` unless one sentence alone is longer."""
    if size < 1 or not 0 <= overlap < size or least < 1:
        raise ValueError("size and least must be positive and overlap must be in [0, size)")
    pieces = sentence_pieces(text)
    ends = [0, *accumulate(map(len, pieces))]
    out, at = [], 0
    while at < len(pieces):
        stop = min(max(bisect_left(ends, ends[at] + size) - 1, at + least, at + 1), len(pieces))
        out.append((text[ends[at] : ends[stop]], ends[at], ends[stop]))
        if stop == len(pieces):
            break
        nxt = stop
        while overlap and nxt - 1 > at and ends[stop] - ends[nxt - 1] <= overlap:
            nxt -= 1
        at = nxt
    return out


def _exploded(df: DataFrame, key: str, text: str, cut) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c, a, b, len(c)) for k, t in zip(batch[key], batch[text], strict=True) if t for i, (c, a, b) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk", "start_index", "end_index", "token_count"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_index long, chunk string, start_index long, end_index long, token_count long")


def sentence_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, least: int = 1) -> DataFrame:
    """A row for each sentence chunk: chunk_index, chunk, start_index, end_index, token_count (characters)."""
    overlap = min(overlap, size - 1)
    return _exploded(df, key, text, lambda t: sentences(t, size, overlap, least))


def paragraph_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """A row for each paragraph chunk: chunk_index, chunk, token_count (characters)."""
    overlap = min(overlap, size - 1)
    return _exploded(df, key, text, lambda t: [(c, 0, 0) for c in paragraphs(t, size, overlap)]).drop("start_index", "end_index")
