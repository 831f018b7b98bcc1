"""BPE encoding and decoding by batched merge rounds in numpy.

The words of many texts lie in one flat array of symbols. A round looks every adjacent pair up by binary search over
the sorted pair keys, finds the lowest rank of each word, and merges its occurrences (of overlapping ones, the left);
words without a known pair are done and leave the array. Words beyond LONG bytes take as many rounds as they have
distinct ranks; theirs go rank by rank over a linked flat array, and a round only touches the pairs of its rank. A word
is encoded once for each task, which keeps what it has met, by content, in a table of bounded size.

A text beyond SLICE_CHARS is handled in parts that are cut where a pre-token must end, so the work space is that of one
part, next to the text and its ids. Only a single word takes space of its own length: some 100 bytes a byte.

Defined cases: a null text counts as empty and has no tokens; special strings inside a text become their special id,
as the library's default has it; repeated rows encode alike; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import ByteBpe, parts, split
from .shared import record_batch, tidy

#: Words and tokens that a task keeps, the longest of these words, the characters handled at once, and the bytes beyond which a word is linked.
KEPT, KEPT_TOKENS, KEPT_CHARS, SLICE_CHARS, LONG = 400_000, 4_000_000, 64, 1 << 20, 2048
#: Characters of several texts that are encoded at once, which takes some 40 bytes each.
GROUP_CHARS = 1 << 18
_NONE = np.iinfo(np.int64).max


class Encoder:
    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        by_rank = np.argsort(self.bpe.ranks, kind="stable")
        self.left, self.right, self.made = self.bpe.keys[by_rank] // self.bpe.base, self.bpe.keys[by_rank] % self.bpe.base, self.bpe.merged[by_rank]
        self.forget()

    def forget(self) -> None:
        """Nothing is known: word -> place; the place's first token and number of tokens in ``flat``."""
        self.known: dict[str, int] = {}
        self.heads, self.sizes, self.flat = (np.zeros(0, np.int64) for _ in range(3))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, by binary search; _NONE if it doesn't merge."""
        key = left * self.bpe.base + right
        at = np.minimum(np.searchsorted(self.bpe.keys, key), len(self.bpe.keys) - 1)
        return np.where(self.bpe.keys[at] == key, self.bpe.ranks[at], _NONE)

    def merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._linked_rounds(w)
        if not short:
            return out
        symbols = self.bpe.symbol[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1] = np.where(word[:-1] == word[1:], self._ranks(symbols[:-1], symbols[1:]), _NONE)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(ranks, heads)
            done = least == _NONE
            lengths = np.diff(np.append(heads, len(word)))
            for k in np.flatnonzero(done):
                out[short[word[heads[k]]]] = symbols[heads[k] : heads[k] + lengths[k]]
            take = np.flatnonzero((ranks == np.repeat(least, lengths)) & (ranks != _NONE))
            if len(take) > 1:  # of a run of overlapping pairs, every other one
                runs = np.concatenate([[True], np.diff(take) != 1])
                place = np.arange(len(take)) - np.maximum.accumulate(np.where(runs, np.arange(len(take)), 0))
                take = take[place % 2 == 0]
            symbols[take] = self.made[ranks[take]] if len(take) else symbols[take]
            stay = ~np.repeat(done, lengths)
            stay[take + 1] = False
            symbols, word = symbols[stay], word[stay]
        return out

    def _linked_rounds(self, data: bytes) -> np.ndarray:
        """One long word: all pairs of the lowest rank merge in a round, which then looks up only the pairs that are new."""
        symbols = self.bpe.symbol[np.frombuffer(data, np.uint8)].copy()
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ready: list[int] = []

        def wait(at: np.ndarray) -> None:
            """Pairs that start at these places, by rank."""
            ranks = self._ranks(symbols[at], symbols[after[at]])
            at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
            order = np.argsort(ranks, kind="stable")
            some, first = np.unique(ranks[order], return_index=True)
            for r, own in zip(some.tolist(), np.split(at[order], first[1:])):
                if r not in waiting:
                    heapq.heappush(ready, r)
                waiting.setdefault(r, []).append(own)

        wait(np.arange(n - 1))
        while ready:
            r = heapq.heappop(ready)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(symbols[at] == self.left[r]) & (after[at] < n)]
            at = at[symbols[after[at]] == self.right[r]]
            if len(at) > 1 and self.left[r] == self.right[r]:  # of a run of overlapping pairs, every other one
                runs = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = self.made[r], -1
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            wait(np.unique(np.concatenate([before[at][before[at] >= 0], inner])))
        return symbols[symbols >= 0]

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the tokens of each word are kept; new words are encoded first."""
        if len(self.known) > KEPT or len(self.flat) > KEPT_TOKENS:
            self.forget()
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0).tolist()
        if not new:
            return places
        fresh = list(dict.fromkeys(words[i] for i in new))
        made = self.merge_rounds([w.encode() for w in fresh])
        first = len(self.heads)
        sizes = np.array([len(x) for x in made], np.int64)
        self.heads = np.concatenate([self.heads, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, *made])
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        places[new] = [self.known[words[i]] for i in new]
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del self.known[w]
        return places

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        pieces, owner, special = [], [], {}
        for i, text in enumerate(texts):
            for p in self.bpe.pieces(text):
                if isinstance(p, int):
                    special[len(pieces)] = p
                    p = ""
                pieces.append(p)
                owner.append(i)
        words, ahead = split(pieces)
        places = self._places(words)
        per = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(per)])
        tokens = self.flat[np.arange(ends[-1]) - np.repeat(ends[:-1], per) + np.repeat(self.heads[places], per)]
        bounds = ends[ahead]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append(np.array([special[k]]) if k in special else tokens[bounds[k] : bounds[k + 1]])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def stream(self, text: str) -> Iterator[np.ndarray]:
        """The token ids of a long text, part by part."""
        for piece in self.bpe.pieces(text):
            if isinstance(piece, int):
                yield np.array([piece])
            else:
                for part in parts(piece, SLICE_CHARS):
                    yield self.encode([part])[0] if part not in self.bpe.specials else np.array([self.bpe.specials[part]])

    def bytes(self, ids: np.ndarray) -> bytes:
        of = self.bpe.bytes_of
        return b"".join([of[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(column: pa.Array, size: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of about ``size`` characters, a longer text alone; null counts as empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


class _Digest:
    """The digests of a text's ids and of what they decode to, fed part by part."""

    def __init__(self, own: Encoder, decimal: np.ndarray):
        self.own, self.decimal, self.n = own, decimal, 0
        self.ids, self.text, self.utf8 = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.ids.update((("," if self.n else "") + ",".join(self.decimal[ids].tolist())).encode())
            self.text.update(self.utf8.decode(self.own.bytes(ids)).encode())
            self.n += len(ids)

    def read(self) -> tuple[int, str, str]:
        self.text.update(self.utf8.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _encoded(own: Encoder, decimal: np.ndarray, texts: list[str], keep: bool) -> list[tuple[np.ndarray, _Digest]]:
    """(ids, or none unless ``keep``; digest) of each text of a slice."""
    long = len(texts) == 1 and len(texts[0]) > SLICE_CHARS
    out = []
    for ids in [own.stream(texts[0])] if long else [[x] for x in own.encode(texts)]:
        digest, kept = _Digest(own, decimal), [np.zeros(0, np.int32)]
        for part in ids:
            digest.add(part)
            if keep:
                kept.append(part.astype(np.int32))
        out.append((np.concatenate(kept), digest))
    return out


def _run(path: str, keep: bool, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        decimal = np.array([str(i) for i in range(own.bpe.base)], object)
        for batch in batches:
            more = [("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())] if keep else [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
            schema = pa.schema([(id_col, batch.schema.field(0).type), *more])
            for lo, hi, texts in slices(batch.column(1), GROUP_CHARS):
                made = _encoded(own, decimal, texts, keep)
                n, ids_sha256, decoded_sha256 = zip(*(digest.read() for _, digest in made))
                columns = {id_col: batch.column(0).slice(lo, hi - lo), "n_tokens": n, "ids_sha256": ids_sha256, "decoded_sha256": decoded_sha256}
                if keep:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in made])]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for x, _ in made])))
                yield record_batch(columns, schema)

    return tidy(run, lambda: encoder(path).forget())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded_sha256) of each document; the digest is that of the text decoded from the ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_run(path, True, id_col), f"`{id_col}` {kind}, ids array<int>, decoded_sha256 string")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the decoded text; null ids decode to null."""
    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(path)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else own.decode(np.asarray(x)))

    return tokens.withColumn(out, decoded(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the round trip of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_run(path, False, id_col), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
