"""Token counts by finite-state tokenizer compilation.

Splitting into pre-tokens is a small transducer whose chunk maps compose in a parallel prefix scan (``pretokens``).
Within pre-tokens a second deterministic transducer counts: it reads bytes, and every transition carries the change
in the number of tokens of what has been read. It rests on two facts of ranked merges: the encoding of a prefix ends
in exactly one token that is compatible with the token before it, and two tokens are compatible if and only if
encoding their joined bytes gives these two. A state is what the future depends on: the longest suffix that begins a
token and, for each suffix that does, the last token before it and how many tokens stand there. States and
transitions are compiled on first use and kept up to a bound.

The bytes of many words form one stream, which is cut into chunks; all chunks run at once. A word's start resets the
transducer, so a chunk's map from the state before it to the state after it and the tokens counted is constant beyond
its first start, and open only on the bytes before. The maps compose in a scan: a chunk that holds a start hands its
end state to the next one at once. Inside words longer than a chunk the state before is guessed first, from the bytes
of the chunk before; where the scan then finds another one, the chunk's map gets an entry for it. Every distinct word
is counted once for each worker, which keeps what it has met up to a bound.

A text beyond SLICE_CHARS is handled in parts that are cut where a pre-token must end, so the work space is that of one
part, next to the text. Only a single word takes space of its own length: some 40 bytes a byte.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; a special string inside a text counts as one token, as
the library's default has it; repeated rows count alike; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import SLICE_CHARS, slices
from .pretokens import ByteBpe, parts, split
from .shared import record_batch, tidy

LIMIT = 1024
#: States and distinct words that a worker keeps, the longest of these words, and the bytes of a chunk.
STATES, KEPT, KEPT_CHARS, CHUNK = 250_000, 600_000, 64, 64


class _Moves:
    """Transitions (state and byte -> next state, change in tokens) in an open hash table that is read and filled by arrays."""

    def __init__(self, size: int = 1 << 12):
        self.n, self.shift = 0, np.uint64(64 - size.bit_length() + 1)
        self.keys, self.to, self.out = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, -1 where there is none; changes in tokens)."""
        at = self._slots(keys)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] >= 0)]
        return np.where(self.keys[at] == keys, self.to[at], -1), self.out[at]

    def add(self, keys: np.ndarray, moves: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            kept = self.keys[old], np.stack([self.to[old], self.out[old]], axis=1)
            self.__init__(1 << int(4 * (self.n + len(keys))).bit_length())
            self.add(*kept)
        self.n += len(keys)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.to[at[won]], self.out[at[won]] = keys[won], moves[won, 0], moves[won, 1]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % len(self.keys)


class CountingTransducer:
    def __init__(self, path: str):
        self.bpe = bpe = ByteBpe(path)
        self.merge = {(int(k) // bpe.base, int(k) % bpe.base): (int(r), int(m)) for k, r, m in zip(bpe.keys, bpe.ranks, bpe.merged, strict=True)}
        special = set(bpe.specials.values())
        self.token_of = {t: i for i, t in bpe.bytes_of.items() if i not in special}
        self.begins = {t[:k] for t in self.token_of for k in range(1, len(t) + 1)}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        """Only the start state: nothing read, and a token may begin here."""
        self.states = [(b"", ((0, -1, 0),))]
        self.number = {self.states[0]: 0}
        self.moves = _Moves()

    def _encode(self, data: bytes) -> list[int]:
        ids = self.bpe.symbol[np.frombuffer(data, np.uint8)].tolist()
        while len(ids) > 1:
            found = [(self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def _fits(self, last: int, token: int) -> bool:
        key = (last, token)
        if key not in self.compatible:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            of = self.bpe.bytes_of
            self.compatible[key] = self._encode(of[token]) == [token] if last < 0 else self._encode(of[last] + of[token]) == [last, token]
        return self.compatible[key]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change in tokens): compiles the transition."""
        suffix, places = self.states[state]
        longer = suffix + bytes([byte])
        for length, last, count in places:  # the longest suffix first
            token = self.token_of.get(longer[len(longer) - length - 1 :])
            if token is not None and self._fits(last, token):
                break
        else:
            raise ValueError("the vocabulary can't encode this text")
        emitted = count + 1
        kept = [(n + 1, last, c - emitted) for n, last, c in places if longer[len(longer) - n - 1 :] in self.begins]
        new = (longer[len(longer) - kept[0][0] :] if kept else b"", (*kept, (0, token, 0)))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], emitted

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes in tokens) of many runs at once; transitions met for the first time are compiled."""
        keys = state.astype(np.int64) << 8 | byte
        nxt, out = self.moves.look(keys)
        if (missing := nxt < 0).any():
            fresh = np.unique(keys[missing])
            self.moves.add(fresh, np.array([self._move(k >> 8, k & 255) for k in fresh.tolist()]))
            nxt[missing], out[missing] = self.moves.look(keys[missing])
        return nxt, out

    def run(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word; words must not be empty."""
        if len(self.states) > STATES:
            self._reset()
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        rows = -(-n // CHUNK)
        data, fresh = np.zeros(rows * CHUNK, np.uint8), np.zeros(rows * CHUNK, bool)
        data[:n] = np.frombuffer(b"".join(words), np.uint8)
        fresh[starts] = True
        data, fresh = data.reshape(rows, CHUNK), fresh.reshape(rows, CHUNK)
        emitted = np.zeros((rows, CHUNK), np.int32)
        first = np.where(fresh.any(axis=1), fresh.argmax(axis=1), CHUNK)  # where each chunk's map stops to depend on the state before

        def through(own: np.ndarray, state: np.ndarray, lo: np.ndarray, hi: np.ndarray, write: bool = True) -> np.ndarray:
            """The state after places lo to hi of the chunks ``own``."""
            state = state.astype(np.int32)
            for i in range(int(lo.min(initial=CHUNK)), int(hi.max(initial=0))):
                on = np.flatnonzero((lo <= i) & (i < hi))
                if len(on):
                    now = np.where(fresh[own[on], i], 0, state[on])
                    state[on], out = self._step(now, data[own[on], i])
                    if write:
                        emitted[own[on], i] = out
            return state

        last = np.full(rows, CHUNK)
        last[-1:] = n - (rows - 1) * CHUNK
        every = np.arange(rows)
        end = np.full(rows, -1, np.int32)
        has = np.flatnonzero(first < CHUNK)
        end[has] = through(has, np.zeros(len(has)), first[has], last[has])
        # chunks without a start: a guess of the state before, and with it the first entry of their maps
        open_ = np.flatnonzero(first == CHUNK)
        guess = np.zeros(rows, np.int32)
        if len(open_):
            ahead = np.flatnonzero((first[open_ - 1] == CHUNK))  # the chunk before has no start either
            guess[open_] = end[open_ - 1]
            guess[open_[ahead]] = through(open_[ahead] - 1, np.zeros(len(ahead)), np.zeros(len(ahead), int), last[open_[ahead] - 1], False)
            end[open_] = through(open_, guess[open_], np.zeros(len(open_), int), last[open_])
            for r in open_.tolist():  # the scan: a wrong guess gets another entry
                if guess[r] != end[r - 1]:
                    end[r] = through(every[r : r + 1], end[r - 1 : r], np.zeros(1, int), last[r : r + 1])[0]
        # now the bytes before each chunk's first start
        part = np.flatnonzero((first > 0) & (first < CHUNK))
        through(part, end[part - 1], np.zeros(len(part), int), first[part])
        return np.add.reduceat(emitted.ravel(), starts) if len(words) else np.zeros(0, np.int64)

    def _counts(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known.clear()
        counts = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(counts < 0).tolist()
        if new:
            fresh = list(dict.fromkeys(words[i] for i in new))
            found = dict(zip(fresh, self.run([w.encode() for w in fresh]).tolist(), strict=True))
            counts[new] = [found[words[i]] for i in new]
            self.known.update((w, c) for w, c in found.items() if len(w) <= KEPT_CHARS)
        return counts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for p in self.bpe.pieces(text):
                if isinstance(p, int):
                    out[i] += 1
                elif len(p) > SLICE_CHARS:
                    for part in parts(p, SLICE_CHARS):
                        out[i] += self._counts(split([part])[0]).sum()
                else:
                    pieces.append(p)
                    owner.append(i)
        words, ahead = split(pieces)
        np.add.at(out, owner, np.diff(np.concatenate([[0], np.cumsum(self._counts(words))])[ahead]))
        return out


_COUNTERS: dict[str, CountingTransducer] = {}


def counter(path: str) -> CountingTransducer:
    """One for each worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = CountingTransducer(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            schema = pa.schema([(id_col, batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            for lo, hi, texts in slices(batch.column(1)):
                n = own.count(texts)
                yield record_batch({id_col: batch.column(0).slice(lo, hi - lo), "n_bytes": np.array([len(t.encode()) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit}, schema)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
