import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluicework.llm import media_copies


def pgm(a):
    return b"P5 %d %d 255\n" % a.shape[::-1] + a.astype(np.uint8).tobytes()


def png(a):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    lines = b"".join(bytes([1]) + np.diff(row.astype(int), prepend=0).astype(np.uint8).tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def picture(seed, side=120):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (side // 8, side // 8)), np.ones((8, 8))).astype(np.uint8)


def test_copies_are_found_and_others_left_alone(spark):
    a, b = picture(1), picture(2)
    noisy = np.clip(a.astype(int) + np.random.default_rng(3).integers(-6, 7, a.shape), 0, 255)
    rows = [(10, pgm(a)), (11, pgm(a)), (12, png(a)), (13, pgm(a[10:100, 15:110])), (14, pgm(np.clip(a * 0.8 + 20, 0, 255))), (15, pgm(noisy)), (16, pgm(np.rot90(a).copy()))]
    rows += [(20, pgm(b))] + [(30 + k, pgm(picture(50 + k))) for k in range(12)]
    rows += [(60, None), (61, b""), (62, b"P5 no"), (63, pgm(np.full((90, 90), 7))), (64, b"\x89PNG\r\n\x1a\nxx"), (None, pgm(a)), (65, pgm(picture(9, 16)))]
    df = spark.createDataFrame(rows, "pic long, image binary").withColumn("id", F.lit("clash"))
    got = {r["id"]: r for r in media_copies.copies(df, "pic", "image").collect()}
    assert len(got) == len(rows) and {i: r["component_id"] for i, r in got.items() if i} == {i: (10 if i < 20 else i) for i, _ in rows if i}
    assert got[63]["n_points"] == got[60]["n_points"] == 0 and got[None]["kept"]
    assert media_copies.copies(df.limit(0), "pic", "image").count() == 0


def test_png_filters():
    a = picture(4)
    assert (media_copies.decode(png(a)) == a).all()


def packed(data):
    (_, _, _, m), = zip(*(c.to_pylist() for c in next(media_copies._described(iter([pa.record_batch({"id": [0], "file": [b""], "image": [data]})]))).columns))
    return m


def brute(media):
    """Components of all pairs that are alike, every two pictures compared."""
    own = {i: packed(data) for i, data in media}
    comp = {i: i for i in own}
    for i in own:
        for j in own:
            if i < j and (own[i] == own[j] or media_copies.alike(own[i], own[j])):
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return comp


def vectors(spark, rows):
    return media_copies.rendered(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("short", [48, 0])
def test_components_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(media_copies, "SHORT", short)  # 0: every list of several components is compared in blocks
    monkeypatch.setattr(media_copies, "BLOCK", 40)
    rng = np.random.default_rng(12)
    base = rng.normal(0, 0.125, (60, 64))
    chain = [base[0]]
    for _ in range(12):  # each a near copy of the one before, the ends unlike
        chain.append(chain[-1] + rng.normal(0, 0.03, 64))
    media = vectors(spark, [*base, *(base[20:50] + rng.normal(0, 0.02, (30, 64))), *chain[1:], base[3], base[3]])
    got = {r["id"]: r["component_id"] for r in media_copies.copies(media, "vec_id", "image").collect()}
    assert got == brute(sorted((r["vec_id"], bytes(r["image"])) for r in media.collect()))
    assert sum(got[60 + k] == 20 + k for k in range(30)) >= 27 and got[102] == got[103] == 3


def test_a_group_of_copies_is_joined_once_and_grows_in_proportion(spark, monkeypatch):
    made, stash = {}, media_copies.stash

    def kept(df, label):
        out = stash(df, label)
        made.setdefault(label, []).append((df._jdf.queryExecution().optimizedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(media_copies, "stash", kept)
    rng = np.random.default_rng(4)
    group, rows = rng.normal(0, 0.125, 64) + rng.normal(0, 0.002, (120, 64)), []
    for n in (60, 120):
        made.clear()
        media = vectors(spark, group[:n])
        assert {r["component_id"] for r in media_copies.copies(media, "vec_id", "image").collect()} == {0}
        rows.append(made["shared"][0][1])
        assert "Join" not in made["pairs"][0][0]  # the hub is in each member's row; a second join made a row for each member again
    assert 1.5 < rows[1] / rows[0] < 2.5


def test_grids_of_flat_cells_go_through_blocks(spark, monkeypatch):
    """Pictures whose corners all look alike share long lists by chance; what the operator says of them is still what all pairs say."""
    monkeypatch.setattr(media_copies, "SHORT", 2)
    monkeypatch.setattr(media_copies, "BLOCK", 25)
    rows = [(k, pgm(np.kron(np.random.default_rng(k % 40).integers(0, 2, (10, 10)) * 200, np.ones((10, 10))) + k // 40)) for k in range(60)]
    got = {r["id"]: r["component_id"] for r in media_copies.copies(spark.createDataFrame(rows, "pic long, image binary"), "pic", "image").collect()}
    assert got == brute(rows) and all(got[40 + k] == got[k] for k in range(20))


def test_an_id_with_several_pictures(spark):
    rows = [(1, pgm(picture(1))), (1, pgm(picture(2))), (1, pgm(picture(1))), (2, pgm(picture(2) // 2 + 60)), (3, pgm(picture(3))), (2**62, pgm(picture(3)))]
    got = [(r["id"], r["component_id"]) for r in media_copies.copies(spark.createDataFrame(rows, "pic long, image binary"), "pic", "image").collect()]
    assert sorted(got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (2**62, 3)]


def test_unsound_pictures():
    assert media_copies.decode(b"P5 99999 99999 255\n") is None
    huge = png(np.zeros((4, 4), np.uint8)).replace(struct.pack(">II", 4, 4), struct.pack(">II", 60000, 60000))
    assert media_copies.decode(huge) is None


def test_repeated_places_do_not_hide_a_consensus():
    good = [(10.0 * k, 7.0 * k * k, 10.0 * k + 3, 7.0 * k * k + 5) for k in range(7)]
    repeated = [(500.0, 0.0, 900.0, 0.0)] * 9
    rows = np.array(good + repeated)
    sides = [np.concatenate([rows[:, c : c + 2], np.zeros((16, 1)), np.ones((16, 1))], axis=1) for c in (0, 2)]
    assert media_copies.agreeing(*sides) == 7 and media_copies.agreeing(*(x[::-1] for x in sides)) == 7
