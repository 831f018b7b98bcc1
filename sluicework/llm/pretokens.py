"""Splitting of texts into byte-level BPE's pre-tokens by a compiled finite-state transducer.

The public splitting pattern (contractions, optional blank + letters, digits or marks, white space but for the blank
before a word) is compiled into a deterministic transducer over classes of characters. A transition says whether a
pre-token starts at the character just read, or at the one before it. All texts of a slice run at once: they are cut
into chunks of equal length, every chunk computes the map from each start state to its end state, the maps compose in
a parallel prefix scan, and a second run from the now known states yields the starts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

_CHUNK = 64
# classes of characters: blank, other white space, letters (those of contractions apart), numbers, marks, ', end of text
_BLANK, _WHITE, _LETTER, _NUMBER, _MARK, _QUOTE, _ONE, _R, _V, _E, _L, _END = range(12)
# states: what the text so far ends with
_FRESH, _IN_L, _IN_N, _IN_M, _B1, _BN, _W1, _WN, _Q, _QR, _QV, _QL = range(12)
_HERE, _BACK = 1, 2
# The letters and numbers that Unicode 16 added, which the tokenizers library knows and Python 3.13 doesn't.
_LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _classes() -> np.ndarray:
    """The class of every code point; the last place is the end of a text."""
    table = np.full(0x110000 + 1, _MARK, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = _LETTER if kind == "L" else _NUMBER
    for ranges, kind in ((_LETTERS_16, _LETTER), (_NUMBERS_16, _NUMBER)):
        for lo, hi in ranges:
            table[lo : hi + 1] = kind
    white = regex.findall(r"\s", "".join(map(chr, range(0x3001))))
    table[[ord(c) for c in white]] = _WHITE
    for chars, kind in ((" ", _BLANK), ("'", _QUOTE), ("stmd", _ONE), ("r", _R), ("v", _V), ("e", _E), ("l", _L)):
        table[[ord(c) for c in chars]] = kind
    table[0x110000] = _END
    return table


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts) by state and class."""
    to, starts = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    opened = {_BLANK: _B1, _WHITE: _W1, _NUMBER: _IN_N, _MARK: _IN_M, _QUOTE: _Q, _END: _FRESH}
    for s in range(12):
        for c in range(12):
            letter, white = c in (_LETTER, _ONE, _R, _V, _E, _L), c in (_BLANK, _WHITE)
            nxt, out = (_IN_L if letter else opened[c]), _HERE
            if s in (_QR, _QV, _QL) and c == {_QR: _E, _QV: _E, _QL: _L}[s]:
                nxt, out = _FRESH, 0
            elif s in (_QR, _QV, _QL):  # no contraction: the letter began a pre-token
                nxt, out = (_IN_L, _BACK) if letter else (nxt, _HERE | _BACK)
            elif s == _Q and c == _ONE:
                nxt, out = _FRESH, 0
            elif s == _Q and c in (_R, _V, _L):
                nxt, out = {_R: _QR, _V: _QV, _L: _QL}[c], 0
            elif s in (_IN_L, _IN_N) and (letter if s == _IN_L else c == _NUMBER) or s in (_IN_M, _Q) and c in (_MARK, _QUOTE):
                nxt, out = (s if s != _Q else _IN_M), 0
            elif s in (_B1, _BN, _W1, _WN) and white:
                nxt, out = (_BN if c == _BLANK else _WN), 0
            elif s in (_B1, _BN) and c != _END:  # the last blank belongs to what follows
                nxt, out = (_IN_M if c == _QUOTE else nxt), (_BACK if s == _BN else 0)
            elif s == _WN and c != _END:
                out = _HERE | _BACK
            to[s, c], starts[s, c] = nxt, out
    return to, starts


_TO, _STARTS = _compile()
_MADE: dict[str, np.ndarray] = {}


def _end_states(kinds: np.ndarray) -> np.ndarray:
    """The state before every character of ``kinds`` (a row for each chunk)."""
    n, width = kinds.shape
    maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (n, 12)).copy()
    for i in range(width):
        maps = _TO[maps, kinds[:, i : i + 1]]
    step = 1
    while step < n:  # inclusive scan of map composition
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    return np.concatenate([[_FRESH], maps[:-1, _FRESH]]).astype(np.uint8)


def starts_of(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each of the characters."""
    n = -(-len(kinds) // _CHUNK)
    padded = np.full(n * _CHUNK, _END, np.uint8)
    padded[: len(kinds)] = kinds
    padded = padded.reshape(n, _CHUNK)
    state, out = _end_states(padded), np.empty((n, _CHUNK), np.uint8)
    for i in range(_CHUNK):
        out[:, i] = _STARTS[state, padded[:, i]]
        state = _TO[state, padded[:, i]]
    out = out.ravel()
    here = (out & _HERE).astype(bool)
    here[:-1] |= (out[1:] & _BACK).astype(bool)
    return here[: len(kinds)]


#: A place where a pre-token ends whatever stands before and after: what follows a letter or digit here belongs to none before it.
_CUT = re.compile(r"(?<=[^\W_])(?=[ \n,.;:!?\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F])")


def parts(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters that split into pre-tokens as the whole does."""
    lo = 0
    while len(text) - lo > 2 * size and (found := _CUT.search(text, lo + size)):
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:] if lo else text


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(the pre-tokens of all texts, the number of them before each text), as the public pattern finds them."""
    if "classes" not in _MADE:
        _MADE["classes"] = _classes()
    if not texts:
        return [], np.zeros(1, np.int64)
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = _MADE["classes"][points]
    kinds[ends] = _END
    at = np.flatnonzero(starts_of(kinds))
    stop = np.append(at[1:], len(points))
    real = kinds[at] != _END
    at, stop = at[real], stop[real]
    words = [joined[a:b] for a, b in zip(at.tolist(), stop.tolist())]
    return words, np.concatenate([[0], np.searchsorted(at, ends)])


class ByteBpe:
    """A byte-level BPE vocabulary from a tokenizers file: symbols of bytes, ranked merges, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        byte_of = {c: b for b, c in shown.items()}
        self.vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in self.vocab.items()}
        self.symbol = np.array([self.vocab.get(shown[b], -1) for b in range(256)], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.specials.items()}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = max(self.bytes_of) + 1
        left, right = np.array([self.vocab[a] for a, _ in pairs], np.int64), np.array([self.vocab[b] for _, b in pairs], np.int64)
        keys, merged = left * self.base + right, np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]

    def pieces(self, text: str) -> list[str | int]:
        """The text cut at special strings, which stand as their ids."""
        if not any(s in text for s in self.specials):
            return [text]
        parts = regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")", text)
        return [self.specials[p] if k % 2 else p for k, p in enumerate(parts)]
