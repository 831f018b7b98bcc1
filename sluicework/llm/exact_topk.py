"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers, floor(1024 * x), and scored by inner products. For a block of queries, every task
scores all its candidates and counts each query's scores in histogram bins; the summed counts tell the bin that holds
the query's kth highest score, and the next round splits only that bin, until it is one score wide or holds few
rows. Then one more pass keeps the scores at or above the bin's lower edge, and a window orders what is left by
score and id. A task sends only bins that may matter: those down to where it alone has k scores. Of equal scores at
the edge it sends the k smallest ids. Queries come in blocks of a fixed size, the only thing that is broadcast.

Components are kept as doubles, which hold floor(1024 * x) exactly whatever its size. Where no sum can exceed 53 bits,
products are added as doubles, else as Python's integers, so every score is exact. Only a score that no long can hold
is cut off at the long's bound.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part, nor do null ids;
vectors of several lengths: a shorter one counts as filled up with zeros; with fewer candidates than k all are
returned; ties go to the smaller id; rows with the same id are rows of their own: each asks if its id does, and each is
a candidate for all rows but itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import record_batch, stash, tidy

K, SCALE, QUERY_BLOCK, BINS = 10, 1024, 4096, 1024
#: Rows in a bin, beyond k, that end its refinement.
FEW = 64
_FLOOR, _CEIL = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double>, whole numbers) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c * scale) < float(1 << 52), F.floor(c * scale).cast("double")).otherwise(c * scale)  # noqa: E731  larger ones are whole
    return rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False))).select("id", F.transform("x", whole).alias("v"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(column), width))
    if len(column) and (lengths == width).all():
        return flat.reshape(len(column), width)
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + n][:width]
        at += n
    return out


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut off where no long can hold them."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = _exact(queries) @ _exact(rows).T
    return np.array([[min(max(x, _FLOOR), _CEIL) for x in row] for row in exact.tolist()], np.int64).reshape(exact.shape)


def _exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


class _Block:
    """Queries: row numbers, ids, vectors, and for each the range of scores that holds its kth."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.low, self.high, self.above = (np.full(len(ids), x, np.int64) for x in (_FLOOR, _CEIL, 0))

    def width(self) -> np.ndarray:
        """The width of a bin, as an unsigned number."""
        return (self.high.astype(np.uint64) - self.low.astype(np.uint64)) // np.uint64(BINS) + np.uint64(1)

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, scores by query, whether they count: all but a query's own row) of a batch, some rows at a time."""
        step = max(1, (1 << 21) // max(len(self.ids), 1))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            row, ids = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield ids, inner(self.vectors, _matrix(part.column(2), self.vectors.shape[1])), self.rows[:, None] != row[None, :]


def _bin(scores: np.ndarray, counts: np.ndarray, block: _Block) -> np.ndarray:
    """The bin of each score within its query's range; -1 outside of it and for what doesn't count."""
    low, high = block.low[:, None], block.high[:, None]
    inside = counts & (scores >= low) & (scores <= high)
    ahead = (np.where(inside, scores, low).astype(np.uint64) - low.astype(np.uint64)) // block.width()[:, None]
    return np.where(inside, ahead.astype(np.int64), -1)


def _histogram(sent, k: int):
    schema = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        counts = np.zeros((len(block.ids), BINS + 1), np.int64)
        place = np.arange(len(block.ids))[:, None] * (BINS + 1)
        for batch in batches:
            for _, scores, others in block.scored(batch):
                counts += np.bincount((_bin(scores, others, block) + 1 + place).ravel(), minlength=counts.size).reshape(counts.shape)
        inside = counts[:, 1:]  # scores above the range were counted by an earlier round
        higher = np.cumsum(inside[:, ::-1], axis=1)[:, ::-1] - inside
        q, at = np.nonzero((inside > 0) & (higher < k))
        yield record_batch({"q": q.astype(np.int32), "bin": at.astype(np.int32), "n": inside[q, at]}, schema)

    return run


def _survivors(sent, k: int):
    schema = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        kept = np.zeros((0, 3), np.int64)  # (query, score, id), at most k for each query
        for batch in batches:
            for ids, scores, others in block.scored(batch):
                q, at = np.nonzero(others & (scores >= block.low[:, None]))
                rows = np.concatenate([kept, np.stack([q, scores[q, at], ids[at]], axis=1)])
                rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]
                heads = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, bool)
                rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(heads, np.arange(len(rows)), 0))
                kept = rows[rank < k]
        yield record_batch({"asked": block.rows[kept[:, 0]], "query_id": block.ids[kept[:, 0]], "vec_id": kept[:, 2].copy(), "score": kept[:, 1].copy()}, schema)

    return run


def _select(candidates: DataFrame, block: _Block, k: int) -> DataFrame:
    """(query_id, vec_id, score): the rows that may be among each query's k highest."""
    context = candidates.sparkSession.sparkContext
    reach = candidates.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.count("*")).first()
    if reach[1]:
        # no score is larger than the product of the lengths
        with np.errstate(over="ignore"):
            most = np.ceil(np.sqrt((block.vectors**2).sum(axis=1)) * np.sqrt(reach[0] or 0) * (1 + 1e-9)) + 1
        small = most < 2.0**62
        block.high[small] = most[small].astype(np.int64)
        block.low[small] = -block.high[small]
    open_ = np.ones(len(block.ids), bool) & bool(reach[1])
    while open_.any():
        sent = context.broadcast(block)
        found = candidates.mapInArrow(tidy(_histogram(sent, k)), "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
        needed = candidates.sparkSession.createDataFrame([(i, int(k - n)) for i, n in enumerate(block.above)], "q int, need long")
        edge = found.withColumn("ahead", ahead).join(F.broadcast(needed), "q").where("ahead < need AND ahead + n >= need").toArrow()
        q = edge.column("q").to_numpy()
        width = block.width()
        closed = open_.copy()
        closed[q] = False
        block.low[closed] = _FLOOR  # fewer candidates than k: all are kept
        at, n, more = (edge.column(c).to_numpy() for c in ("bin", "n", "ahead"))
        low = block.low[q].astype(np.uint64) + at.astype(np.uint64) * width[q]
        last = np.minimum(width[q] - np.uint64(1), block.high[q].astype(np.uint64) - low)  # from the bin's first score on
        done = (width[q] <= 1) | (n <= FEW) | ~open_[q]
        now = open_[q]
        block.low[q[now]], block.high[q[now]] = low[now].astype(np.int64), (low + last)[now].astype(np.int64)
        block.above[q[now]] += more[now]
        open_[:] = False
        open_[q[~done]] = True
    return candidates.mapInArrow(tidy(_survivors(context.broadcast(block), k)), "asked bigint, query_id bigint, vec_id bigint, score bigint")


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best of all other rows."""
    rows = integers(vectors, id_col, vector_col, scale)
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    asked = stash(rows.where(queries), "queries")
    schema = "query_id bigint, vec_id bigint, score bigint"
    found, after = [], None
    while True:  # one block of queries at a time, in the order of their ids
        block = asked.where((F.col("id") > after[0]) | ((F.col("id") == after[0]) & (F.col("row") > after[1]))) if after else asked
        block = block.orderBy("id", "row").limit(query_block).toArrow()
        if not block.num_rows:
            break
        after = tuple(int(block.column(c)[-1].as_py()) for c in ("id", "row"))
        row, ids, matrix = block.column("row").to_numpy(), block.column("id").to_numpy(), block.column("v").combine_chunks()
        made = _select(rows, _Block(row.copy(), ids.copy(), _matrix(matrix).copy()), k)
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
        found.append(stash(made.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top"))
    if not found:
        return vectors.sparkSession.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    return reduce(DataFrame.unionByName, found)


def nearest_sql(k: int = K, scale: int = SCALE) -> str:
    return f"""
WITH ok AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.r <> q.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
