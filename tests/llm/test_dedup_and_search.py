import math
import random
import re
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sluicework.llm import exact_topk, minhash_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def family(rng, start, n, edits, words=60):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((start + k, " ".join(own)))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = family(rng, 100, 40, 3) + family(rng, 0, 25, 2, 200) + family(rng, 300, 10, 9)
    shared = " ".join(f"p{i}" for i in range(50))
    rows += [(500 + k, shared + " " + " ".join(f"u{k}x{i}" for i in range(60))) for k in range(30)]  # a passage in many
    rows += [(900, ""), (901, None), (902, "One two"), (903, "one TWO"), (904, "one"), (905, " \t\n "), (906, rows[0][1]), (907, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert got[900] == (0, 900, True) and got[903][1] == 902


def test_blocks_link_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)  # many blocks
    rows = family(random.Random(8), 0, 40, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(7, a), (7, a), (9, a), (7, b), (8, b), (None, a), (10, "z")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["component_id"]) for r in got} == {(7, 7), (8, 7), (9, 7), (10, 10), (None, None)} and len(got) == 7
    kept = minhash_dedup.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["10", "7", "None"]


def test_regular_words_do_not_link(spark):
    word = lambda n, a, b: "".join(b if i.bit_count() % 2 else a for i in range(n))
    texts = [word(n, *ab) for n in (1024, 4096) for ab in ("ab", "ba")]
    texts += [" ".join(word(1024, *("ab" if (k + j).bit_count() % 2 else "ba")) for j in range(8)) for k in range(4)]
    rows = list(enumerate(texts))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_repeated_id_keeps_one_text_for_good(spark):
    rows = [(7, "a b c d e f g h", "x"), (7, "q r s t u v w x", "y"), (7, "a b c d e f g h", "x"), (9, "z", "z")]
    seen = {tuple(sorted(map(tuple, minhash_dedup.one_of_each_group(spark.createDataFrame(order, "doc_id long, text string, size string")).collect()))) for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(seen) == 1 and [r[0] for r in seen.pop()] == [7, 9]


def test_empty_table(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert exact_topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).count() == 0


@pytest.mark.parametrize("block", [1, 100])
def test_top_k_equals_brute_force_with_ties(spark, block):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1e9] * 6), (405, [-1e30] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = exact_topk.nearest(df, F.col("id") % 50 == 0, k=10, query_block=block).collect()

    assert {tuple(r) for r in got} == best(rows, 50) and len(got) == len(best(rows, 50))


def best(rows, every, k=10):
    """The rows that a search must give, in Python's integers; only what no long can hold is cut off."""
    ints = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v and all(x is not None and abs(x) < float("inf") for x in v)]
    want = set()
    for n, (q, own) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for m, (i, v) in enumerate(ints) if m != n)
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return want


def test_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0]), (1, [2.0**31]), (2, [2.0**32]), (3, [2.0**33]), (4, [-(2.0**43) - 0.5]), (5, [3e15 + 0.5]), (6, [1e300]), (7, [-1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in exact_topk.nearest(df, F.col("id") == 0).collect()}
    assert got == best(rows, 10) and (0, 4, 2, 2**52) in got
    rng = random.Random(6)
    rows = [(rng.randrange(40), [rng.uniform(-1e9, 1e9) for _ in range(3)]) for _ in range(300)]
    got = [tuple(r) for r in exact_topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, query_block=7).collect()]
    assert set(got) == best(rows, 10) and len(got) == 10 * sum(i % 10 == 0 for i, _ in rows)
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0])]
    got = sorted(tuple(r) for r in exact_topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect())
    assert got == [(0, 1, 1, 3 << 20), (0, 1, 1, 6 << 20), (0, 2, 0, 2 << 20), (0, 2, 0, 2 << 20)]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.nearest(df, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2097152), (0, 2, 2, -1048576)]
