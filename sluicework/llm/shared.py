"""Helpers that the training-data operators share: stored intermediates, text slices, hashes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 1 << 20
#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which its owner clears.

    Where that is unset, a local session gets a temporary folder, which goes when Python ends; a cluster is refused, as
    its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if "dir" not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN["dir"] = "file://" + (made := tempfile.mkdtemp(prefix="sluicework-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _OWN["dir"]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``max_bytes``, a longer text alone; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(data: np.ndarray, offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, start) of consecutive parts of about ``size`` (SLICE_BYTES), cut before white space, so that no word is split.

    The offsets of a part are those of all texts, moved and clipped to it. Only a single word longer than ``size`` makes
    a longer part.
    """
    size = size or SLICE_BYTES
    if len(data) <= 2 * size:
        yield data, offsets, 0
        return
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data):
            ahead = data[hi : hi + 65536]
            found = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))
            if len(found):
                hi += int(found[0])
                break
            hi += len(ahead)
        yield data[lo:hi], np.clip(offsets, lo, hi) - lo, lo
        lo = hi


def release() -> None:
    """Give the system back what a worker has freed: workers are reused, and one stage's heap would add to the next's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], drop: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, which at the end of its task calls ``drop`` and gives its memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            drop()
            release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit words."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_LANES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a run up to which it is hashed in lanes of 8; longer runs by BLAKE2, one by one.
LANED = 64


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes. Runs of up to 8 bytes and equal length never collide, others by chance only."""
    lengths = ends - starts
    out = mix64(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, k = np.flatnonzero(lengths <= LANED), 0
    while len(at):
        left = lengths[at] - 8 * k
        part = lanes[starts[at] + 8 * k] & _LANES[np.minimum(left, 8)]
        out[at] = mix64((out[at] ^ part) * np.uint64(0xD6E8FEB86659FD93))
        at, k = at[left > 8], k + 1
    for i in np.flatnonzero(lengths > LANED):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text): the words of concatenated texts; none crosses texts."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens, closes = inside.copy(), np.zeros(len(data) + 1, bool)
    opens[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = inside[edges]
    closes[1:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    closes[-1] = inside[-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words before each text, length of each word); long data go window by window."""
    hashes, lengths, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(offsets), np.int64)
    for part, ends_of, _ in windows(data, offsets):
        starts, ends, ahead = word_spans(part, ends_of)
        hashes.append(run_hashes(fold_case(part), starts, ends))
        lengths.append(ends - starts)
        before += ahead
    return np.concatenate(hashes), before, np.concatenate(lengths)


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
