"""The models' vectorised features and scores against plain Python, text by text."""

import math
import random
import re
import tracemalloc
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest

from sluicework.llm import language_id, quality_gam

MASK = (1 << 64) - 1


def texts():
    rng = random.Random(7)
    bits = ["Word", "LOUD", "a", "is", "extraordinarily-long", "12", "x9!", "!!", "...", "|", "$$", "é中", "\n", "\t", " ", "  ", "The", "the", "the"]
    return ["", " ", "a", "\n\n", "!!!!"] + ["".join(rng.choice(bits) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 80))) for _ in range(120)]


def laid_out(rows):
    data = [t.encode() for t in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def features(text):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    size, some, low = max(len(data), 1), max(len(words), 1), [w.lower() for w in words]
    among = lambda chars: sum(bytes([b]) in chars for b in data) / size
    is_mark = lambda b: b < 128 and not (chr(b).isalnum() or b in b" \t\n\v\f\r")
    count = lambda test: sum(map(test, words)) / some
    upper, lower, digits, high = (sum(test(b) for b in data) / size for test in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b >= 128))
    return dict(
        bytes=math.log1p(len(data)), words=math.log1p(len(words)), word_length=sum(map(len, words)) / some, letters=upper + lower + high, upper=upper, digits=digits,
        spaces=sum(b in b" \t\v\f\r" for b in data) / size, newlines=data.count(b"\n") / size, marks=sum(map(is_mark, data)) / size, high_bytes=high,
        exclamations=data.count(b"!") / size, periods=data.count(b".") / size, commas=data.count(b",") / size, symbols=sum(b in b"#$%&*+<=>@\\^_`~{}" for b in data) / size,
        bars=data.count(b"|") / size, doubled_marks=sum(a == b and is_mark(a) for a, b in zip(data, data[1:])) / size, distinct_words=len(set(low)) / some,
        commonest_word=max(map(low.count, low), default=0) / some, repeated_next=sum(a == b for a, b in zip(low, low[1:])) / some,
        distinct_pairs=len(set(zip(low, low[1:]))) / (len(low) - 1) if len(low) > 1 else 0, short_words=count(lambda w: len(w) <= 3), long_words=count(lambda w: len(w) >= 15),
        capital_words=count(lambda w: 2 * sum(65 <= b <= 90 for b in w) > len(w)), words_with_marks=count(lambda w: any(map(is_mark, w))),
        line_words=len(words) / (data.count(b"\n") + 1), longest_word=math.log1p(max(map(len, words), default=0)),
    )


def test_features_and_scores_equal_plain_python():
    rows = texts()
    x = quality_gam.measure(*laid_out(rows))
    for k, text in enumerate(rows):
        assert x[k] == pytest.approx([features(text)[f] for f in quality_gam.FEATURES], abs=1e-12), text
    y = np.array([len(t) % 3 == 0 for t in rows], float)
    model = quality_gam.AdditiveModel(rounds=10, pair_rounds=5).fit(x, y)
    assert model.pairs and any(t.any() for t in model.pair_tables)
    got = model.score(x)
    for k, row in enumerate(x.tolist()):
        bins = [bisect_right(cuts.tolist(), v) for cuts, v in zip(model.cuts, row)]
        coarse = [b * model.pair_bins // (len(c) + 1) for b, c in zip(bins, model.cuts)]
        margin = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[coarse[e]][coarse[f]] for (e, f), t in zip(model.pairs, model.pair_tables))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_scoring_takes_little_space_and_no_slicing_changes_a_score():
    rows = ["".join(random.Random(k).choices("ab cde fgh. ", k=2000)) + chr(10) + "x" * (k % 7) for k in range(2000)] + [None, ""]
    x = quality_gam.measure(*laid_out([t or "" for t in rows]))
    model = quality_gam.AdditiveModel(rounds=3, pair_rounds=2).fit(x, np.arange(len(rows)) % 2 * 1.0)
    column = pa.array(rows)
    tracemalloc.start()
    (got,) = quality_gam._scores(model, iter([column]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == model.score(x).tolist()
    assert peak < 6 * column.nbytes  # slices of 1 MB took 12 times the column's 4 MB


def test_a_tree_finds_the_best_cuts():
    rng = np.random.default_rng(3)
    model = quality_gam.AdditiveModel(leaves=2)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + model.penalty)
    cut = max(range(1, 9), key=lambda c: worth(0, c) + worth(c, 9))
    want = [g[a:b].sum() / (h[a:b].sum() + model.penalty) for a, b in [(0, cut)] * cut + [(cut, 9)] * (9 - cut)]
    assert model._tree(g, h) == pytest.approx(want)


def plain_buckets(text, buckets):
    """The buckets of all runs of 1 to 4 bytes, hashed one by one."""
    data = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
    out = []
    for size in range(1, language_id.LONGEST + 1):
        for at in range(len(data) - size + 1):
            h = 0
            for k in range(size):
                h = (h + data[at + k] + k + 1) * int(language_id._PLACE[k]) & MASK
                h ^= h >> 29
            out.append((h * 0x9E3779B97F4A7C15 & MASK) >> (64 - buckets.bit_length() + 1))
    return out


def test_languages_equal_plain_python():
    rows, model = texts(), language_id.LanguageModel(buckets=1 << 10)
    rng = np.random.default_rng(5)
    model.langs, model.logits, model.bias, model.temperature = list("abc"), rng.normal(size=(1 << 10, 3)).astype(np.float32), rng.normal(size=3), 0.7
    best, score = model.predict(*laid_out(rows))
    for k, text in enumerate(rows):
        own = plain_buckets(text, model.buckets)
        z = [(sum(float(model.logits[b][c]) for b in own) / max(len(own), 1) + float(model.bias[c])) / 0.7 for c in range(3)]
        p = [math.exp(v - max(z)) / sum(math.exp(w - max(z)) for w in z) for v in z]
        assert best[k] == p.index(max(p)) and score[k] == pytest.approx(max(p), abs=1e-5)
