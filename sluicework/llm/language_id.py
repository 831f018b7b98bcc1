"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's subwords are the byte runs of 1 to 4 places of its lower-cased form, blanks and marks counting as one blank.
Each is hashed to a row of an embedding table; the text's vector is the mean over all its subwords, and a linear
softmax gives the languages' probabilities. As that softmax is linear in the mean, scoring adds up rows of the
product of both tables, so a whole text costs a few additions for each byte. A temperature is fitted on a part of
the sample that was kept from training, and so is the rejection limit: the score below which a prediction is not
accepted, such that the kept part loses at most ``REJECT`` of its rows.

The model learns from at most ``MAX_TRAIN`` rows (the smallest by a hash of the id); every document is predicted.
Language, source and id are no inputs of a prediction.

Defined cases: a null text or one without a letter is ``und`` with a score of 0 and not accepted; so is every text if
there is nothing to learn from; null languages or ids teach nothing; repeated rows are predicted alike, and rows that
share an id and language teach once; an empty table gives an empty result; further columns are ignored. Only A-Z are
lower-cased. A long text is read in windows, whose work space is some 100 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, id_bucket, random_words, record_batch, text_slices, tidy

MAX_TRAIN, BUCKETS, DIM, LONGEST = 2_000, 1 << 14, 16, 4
REJECT = 0.005

_PLACE = random_words(LONGEST, 23)


def _plain() -> np.ndarray:
    """Lower-case letters and high bytes as they are, all else blank."""
    k = np.full(256, 32, np.uint8)
    k[97:123], k[128:] = np.arange(97, 123), np.arange(128, 256)
    k[65:91] = np.arange(97, 123)
    return k


_PLAIN = _plain()


def subwords(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every subword, by length; none crosses texts."""
    plain = _PLAIN[data].astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    hashed = np.zeros(len(plain), np.uint64)
    for size in range(1, LONGEST + 1):
        n = len(plain) - size + 1
        if n <= 0:
            return
        hashed = (hashed[:n] + plain[size - 1 :] + np.uint64(size)) * _PLACE[size - 1]
        hashed ^= hashed >> np.uint64(29)
        whole = row[:n] == row[size - 1 :]
        yield (((hashed * np.uint64(0x9E3779B97F4A7C15)) >> shift)[whole].astype(np.int64), row[:n][whole])


def counted(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """subwords() of texts, or of the windows of one long text; windows overlap by what a subword that starts in one may need."""
    if len(offsets) != 2 or len(data) <= 2 * SLICE_BYTES:
        yield from subwords(data, offsets, buckets)
        return
    for lo in range(0, len(data), SLICE_BYTES):
        part = data[lo : lo + SLICE_BYTES + LONGEST - 1]
        for at, row in subwords(part, np.array([0, len(part)]), buckets):
            yield at[:SLICE_BYTES], row[:SLICE_BYTES]


class LanguageModel:
    """``langs`` and, for each bucket, what a subword adds to each language's logit."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 6, rate: float = 0.5, seed: int = 1):
        self.buckets, self.dim, self.epochs, self.rate, self.seed = buckets, dim, epochs, rate, seed
        self.langs: list[str] = []
        self.logits = np.zeros((buckets, 0), np.float32)
        self.bias = np.zeros(0)
        self.temperature, self.limit = 1.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> LanguageModel:
        """rows: (buckets, counts) of each text."""
        self.langs = sorted(set(langs))
        if not self.langs:
            return self
        rng = np.random.default_rng(self.seed)
        y = np.array([self.langs.index(x) for x in langs])
        table = rng.normal(0, 1 / self.dim, (self.buckets, self.dim))
        soft = rng.normal(0, 0.1, (len(self.langs), self.dim))
        bias = np.zeros(len(self.langs))
        kept = np.arange(len(rows)) % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
        taught = np.flatnonzero(~kept)
        for epoch in range(self.epochs):
            step = self.rate * (1 - epoch / self.epochs)
            for i in rng.permutation(taught):
                at, weight = rows[i][0], (rows[i][1] / max(rows[i][1].sum(), 1))[:, None]
                mean = (table[at] * weight).sum(axis=0)
                p = self._soft(soft @ mean + bias)
                p[y[i]] -= 1
                back = p @ soft
                soft -= step * np.outer(p, mean)
                bias -= 0.1 * step * p
                table[at] -= step * len(at) ** 0.5 * weight * back
        self.logits, self.bias = (table @ soft.T).astype(np.float32), bias
        if kept.any():
            raw = np.stack([(self.logits[rows[i][0]] * rows[i][1][:, None]).sum(axis=0) / max(rows[i][1].sum(), 1) + bias for i in np.flatnonzero(kept)])
            want = y[kept]
            loss = lambda t: -np.log(np.maximum(self._soft(raw / t)[np.arange(len(want)), want], 1e-12)).mean()
            self.temperature = float(min(np.geomspace(0.05, 4, 40), key=loss))
            self.limit = float(np.quantile(self._soft(raw / self.temperature).max(axis=1), REJECT))
        return self

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into langs, score) for each text."""
        n = len(offsets) - 1
        sums, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for at, row in counted(data, offsets, self.buckets):
            ends = np.searchsorted(row, np.arange(n + 1))
            some = np.flatnonzero(np.diff(ends))
            if len(some):
                sums[some] += np.add.reduceat(self.logits[at], ends[some], axis=0)
            count += np.diff(ends)
        p = self._soft((sums / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def _counted(buckets: int):
    schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(3)):
                at, n = [], []
                for i in range(hi - lo):
                    own = data[offsets[i] : offsets[i + 1]]
                    counts = sum((np.bincount(b, minlength=buckets) for b, _ in counted(own, np.array([0, len(own)]), buckets)), np.zeros(buckets, np.int64))
                    at.append(np.flatnonzero(counts).astype(np.int32))
                    n.append(counts[at[-1]].astype(np.int32))
                own = {c: batch.column(k).slice(lo, hi - lo) for k, c in enumerate(("id", "lang", "h"))}
                yield record_batch({**own, "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.int32()))}, schema)

    return run


LETTER = r"\p{L}"


def held_out(id_col: str = "doc_id", folds: int = 3):
    return F.coalesce(id_bucket(F.col(id_col), folds) == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN, **options) -> LanguageModel:
    """Fit on documents with a language and a letter; at most ``max_rows`` of them, and of rows that share an id and language one, the smallest by a hash of its text."""
    model = LanguageModel(**options)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).cast("string").alias("__text")).dropna()
    chosen = rows.where(F.col("__text").rlike(LETTER)).select("__id", "__lang").orderBy(F.xxhash64("__id"), "__id", "__lang").limit(max_rows).distinct()
    taught = rows.join(F.broadcast(chosen), ["__id", "__lang"]).select(F.col("__id").cast("string").alias("id"), F.col("__lang").alias("lang"), F.xxhash64("__text").alias("h"), "__text")
    taught = taught.mapInArrow(tidy(_counted(model.buckets)), "id string, lang string, h bigint, at array<int>, n array<int>")
    found = taught.groupBy("id", "lang").agg(F.min_by(F.struct("at", "n"), "h").alias("m")).select("lang", "m.at", "m.n").toArrow()
    rows = sorted(zip(found.column("lang").to_pylist(), found.column("at").to_pylist(), found.column("n").to_pylist(), strict=True))
    order = np.random.default_rng(0).permutation(len(rows))
    return model.fit([(np.array(rows[i][1], np.int64), np.array(rows[i][2], float)) for i in order], [rows[i][0] for i in order])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted (score at or above the calibrated limit)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [np.zeros(0, object)], [np.zeros(0)]
            for lo, hi, data, offsets in text_slices(pa.Array.from_pandas(texts, type=pa.large_string())):
                if sent.value.langs:
                    best, p = sent.value.predict(data, offsets)
                    langs.append(np.array(sent.value.langs, object)[best])
                    scores.append(p)
                else:
                    langs.append(np.full(hi - lo, "und", object))
                    scores.append(np.zeros(hi - lo))
            yield pd.DataFrame({"lang": np.concatenate(langs), "score": np.concatenate(scores)})

    text = F.col(text_col).cast("string")
    no = ~F.coalesce(text.rlike(LETTER), F.lit(False))
    out = docs.withColumn("__p", predicted(text)).withColumn("lang_pred", F.when(no, "und").otherwise(F.col("__p.lang")))
    out = out.withColumn("score", F.when(no, 0.0).otherwise(F.col("__p.score"))).drop("__p")
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("score") >= model.limit))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) of each document, from a model that learnt without the held-out fold."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    found = predict(docs.select(F.col(id_col), F.col(text_col).alias("__text")), model, "__text")
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "accepted")
