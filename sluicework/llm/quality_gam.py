"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured on whole texts. Cyclic boosting fits one shallow tree at a time, feature by feature, on binned
values; the trees of a feature add up to a lookup table over its bins. The strongest pairs of features then get small
two-dimensional tables the same way. A score is the logistic of an intercept plus one table entry for each feature
and pair, found by vectorised bin additions.

The model learns from at most ``MAX_TRAIN`` labelled rows (the smallest by a hash of the id), whatever the size of
the corpus; every document is scored. Labels, language, source and id are no features.

Defined cases: a null text counts as empty and gets a score like any other; null labels or ids teach nothing; with
no labels, or labels of one kind only, every score is their smoothed mean (0.5 without any); repeated rows score
alike, and rows that share an id and label teach once; an empty table gives an empty result; further columns are
ignored. A long text is read in windows; its words take some 30 bytes each next to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_case, id_bucket, mix64, record_batch, release, run_hashes, text_slices, tidy, windows, word_spans

MAX_TRAIN, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 10
THRESHOLD = 0.3
#: Bytes of text measured at once, which take some 50 times as much work space.
SLICE = 1 << 18

FEATURES = (
    "bytes", "words", "word_length", "letters", "upper", "digits", "spaces", "newlines", "marks", "high_bytes",
    "exclamations", "periods", "commas", "symbols", "bars", "doubled_marks", "distinct_words", "commonest_word",
    "repeated_next", "distinct_pairs", "short_words", "long_words", "capital_words", "words_with_marks", "line_words",
    "longest_word",
)

# kinds of bytes
_UPPER, _LOWER, _DIGIT, _SPACE, _BREAK, _HIGH, _BANG, _DOT, _COMMA, _SYMBOL, _BAR, _MARK = range(12)


def _kinds() -> np.ndarray:
    k = np.full(256, _MARK, np.uint8)
    k[65:91], k[97:123], k[48:58], k[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    k[[32, 9, 11, 12, 13]], k[10], k[33], k[46], k[44], k[124] = _SPACE, _BREAK, _BANG, _DOT, _COMMA, _BAR
    k[[ord(c) for c in "#$%&*+<=>@\\^_`~{}"]] = _SYMBOL
    return k


_KIND = _kinds()
_MARKED = np.isin(np.arange(12), (_BANG, _DOT, _COMMA, _SYMBOL, _BAR, _MARK))


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums of bytes and words for each text, hashes of words, words before each text, lengths of words) of one window."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _KIND[data]
    marks = _MARKED[kinds]
    doubled = np.zeros(len(data), bool)
    if len(data) > 1:
        doubled[1:] = marks[1:] & (data[1:] == data[:-1]) & (row[1:] == row[:-1])
    starts, ends, before = word_spans(data, offsets)
    of, lengths = np.repeat(np.arange(n), np.diff(before)), ends - starts
    edge = np.concatenate([[0], np.cumsum(marks)])
    upper = np.concatenate([[0], np.cumsum(kinds == _UPPER)])
    per_text = [np.bincount(row * 12 + kinds, minlength=n * 12).reshape(n, 12)]
    per_text += [np.bincount(row, weights=x, minlength=n)[:, None] for x in (marks, doubled)]
    per_text += [np.bincount(of, weights=x, minlength=n)[:, None] for x in (lengths, lengths <= 3, lengths >= 15, (upper[ends] - upper[starts]) * 2 > lengths, edge[ends] > edge[starts])]
    return np.concatenate(per_text, axis=1).astype(float), run_hashes(fold_case(data), starts, ends), before, lengths


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each of the concatenated texts; long data go window by window."""
    n = len(offsets) - 1
    sums, before, hashes, lengths = np.zeros((n, 19)), np.zeros(n + 1, np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part, ends_of, _ in windows(data, offsets):
        own, h, ahead, sizes = _sums(part, ends_of)
        sums += own
        before += ahead
        hashes.append(h)
        lengths.append(sizes)
    hashes, lengths = np.concatenate(hashes), np.concatenate(lengths)
    counts, (marked, doubled, letters_in, short, long, capital, with_marks) = sums[:, :12], sums[:, 12:].T
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = np.diff(before).astype(float)
    some = np.maximum(words, 1)
    same, distinct, commonest, pairs, longest = (np.zeros(n) for _ in range(5))
    for i in range(n):
        own = hashes[before[i] : before[i + 1]]
        if len(own):
            order = np.sort(own)
            cuts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]]))
            distinct[i], commonest[i] = len(cuts) - 1, np.diff(cuts).max()
            longest[i] = lengths[before[i] : before[i + 1]].max()
            if len(own) > 1:
                same[i] = np.count_nonzero(own[1:] == own[:-1])
                two = np.sort(mix64(own[1:] * np.uint64(3) + own[:-1]))
                pairs[i] = (1 + np.count_nonzero(two[1:] != two[:-1])) / len(two)
    share = counts / size[:, None]
    at = dict(
        bytes=np.log1p(np.diff(offsets)), words=np.log1p(words), word_length=letters_in / some,
        letters=share[:, _UPPER] + share[:, _LOWER] + share[:, _HIGH], upper=share[:, _UPPER], digits=share[:, _DIGIT],
        spaces=share[:, _SPACE], newlines=share[:, _BREAK], marks=marked / size,
        high_bytes=share[:, _HIGH], exclamations=share[:, _BANG], periods=share[:, _DOT], commas=share[:, _COMMA],
        symbols=share[:, _SYMBOL], bars=share[:, _BAR], doubled_marks=doubled / size,
        distinct_words=distinct / some, commonest_word=commonest / some, repeated_next=same / some, distinct_pairs=pairs,
        short_words=short / some, long_words=long / some, capital_words=capital / some,
        words_with_marks=with_marks / some, line_words=words / (counts[:, _BREAK] + 1), longest_word=np.log1p(longest),
    )
    return np.stack([at[f] for f in FEATURES], axis=1)


class AdditiveModel:
    """Lookup tables over binned features and pairs; ``score`` adds them up."""

    def __init__(self, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, penalty: float = 2.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.pair_rounds, self.rate, self.leaves, self.penalty = bins, pair_bins, pairs, rounds, pair_rounds, rate, leaves, penalty
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.intercept = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1)

    def _coarse(self, b: np.ndarray, f: int) -> np.ndarray:
        return b * self.pair_bins // (len(self.cuts[f]) + 1)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Leaf values over bins of the shallow tree that best fits the gradients."""
        gain = lambda gs, hs: gs * gs / (hs + self.penalty)
        parts = [(0, len(g))]
        while len(parts) < self.leaves:
            best = (1e-9, 0, 0)
            for k, (a, b) in enumerate(parts):
                if b - a > 1:
                    gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                    won = gain(gs[:-1], hs[:-1]) + gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - gain(gs[-1], hs[-1])
                    best = max(best, (float(won.max()), k, a + 1 + int(won.argmax())))
            if not best[2]:
                break
            a, b = parts[best[1]]
            parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
        out = np.empty(len(g))
        for a, b in parts:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.penalty)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        mean = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(mean / (1 - mean)))
        if len(np.unique(y)) < 2:
            return self
        b, margin = self._binned(x), np.full(len(y), self.intercept)
        slopes = lambda: (y - (p := 1 / (1 + np.exp(-margin))), np.maximum(p * (1 - p), 1e-6))
        for _ in range(self.rounds):
            for f, table in enumerate(self.tables):
                if len(table) > 1:
                    g, h = slopes()
                    step = self.rate * self._tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)))
                    table += step
                    margin += step[b[:, f]]
        g, h = slopes()
        wide = [f for f, t in enumerate(self.tables) if len(t) > 1]
        coarse, k = {f: self._coarse(b[:, f], f) for f in wide}, self.pair_bins

        def worth(e: int, f: int) -> float:
            cell = coarse[e] * k + coarse[f]
            gs, hs = np.bincount(cell, g, k * k), np.bincount(cell, h, k * k)
            return float((gs * gs / (hs + self.penalty)).sum())

        self.pairs = sorted(((e, f) for e in wide for f in wide if e < f), key=lambda p: -worth(*p))[: self.n_pairs]
        self.pair_tables = [np.zeros((k, k)) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for (e, f), table in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slopes()
                cell = coarse[e] * k + coarse[f]
                gs, hs = np.bincount(cell, g, k * k).reshape(k, k), np.bincount(cell, h, k * k).reshape(k, k)
                # one cut in the first feature, one in the second on either side
                best, step = -1.0, np.zeros((k, k))
                for cut in range(1, k):
                    sides = [self._half(gs[s].sum(axis=0), hs[s].sum(axis=0)) for s in (slice(None, cut), slice(cut, None))]
                    if (won := sides[0][0] + sides[1][0]) > best:
                        best = won
                        step[:cut], step[cut:] = sides[0][1], sides[1][1]
                step *= self.rate
                table += step
                margin += step[coarse[e], coarse[f]]
        return self

    def _half(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        gs, hs = np.cumsum(g), np.cumsum(h)
        won = gs[:-1] ** 2 / (hs[:-1] + self.penalty) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.penalty)
        cut = int(won.argmax()) + 1
        low, high = gs[cut - 1] / (hs[cut - 1] + self.penalty), (gs[-1] - gs[cut - 1]) / (hs[-1] - hs[cut - 1] + self.penalty)
        return float(won.max()), np.where(np.arange(len(g)) < cut, low, high)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, margin = self._binned(x), np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            margin += table[b[:, f]]
        for (e, f), table in zip(self.pairs, self.pair_tables, strict=True):
            margin += table[self._coarse(b[:, e], e), self._coarse(b[:, f], f)]
        return 1 / (1 + np.exp(-margin))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("y", pa.int32()), ("h", pa.int64()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(3), SLICE):
            x = measure(data, offsets)
            ends = np.arange(hi - lo + 1, dtype=np.int32) * len(FEATURES)
            own = {c: batch.column(k).slice(lo, hi - lo) for k, c in enumerate(("id", "y", "h"))}
            yield record_batch({**own, "x": pa.ListArray.from_arrays(ends, pa.array(x.ravel()))}, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN, **options) -> AdditiveModel:
    """Fit on the labelled documents; ``labels`` holds (id, label). At most ``max_rows`` labels are used, and of rows that share an id and label one, the smallest by a hash of its text."""
    taught = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).dropna()
    taught = taught.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(taught), "__id")
    rows = rows.select(F.col("__id").cast("string").alias("id"), F.col("__y").alias("y"), F.xxhash64("__text").alias("h"), "__text")
    found = rows.mapInArrow(tidy(_measured), "id string, y int, h bigint, x array<double>").groupBy("id", "y").agg(F.min_by("x", "h").alias("x")).toArrow()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model however the rows arrive
    return AdditiveModel(**options).fit(x[order], y[order])


def _scores(model: AdditiveModel, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The scores of each batch of texts, which stay in Arrow's buffers."""
    for texts in batches:
        parts = [model.score(measure(data, offsets)) for _, _, data, offsets in text_slices(texts, SLICE)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0))


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1, higher: better)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _scores(sent.value, batches)
        release()

    return docs.withColumn(out, scored(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the ids whose labels teach nothing."""
    return F.coalesce(id_bucket(F.col(id_col), folds) == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of each document, from a model that learnt without the held-out fold."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

