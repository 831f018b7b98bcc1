"""Media columns: edited and cropped copies of pictures, found by local descriptors.

A picture is decoded (PGM, or PNG with 8 bits a channel) to grey levels and shrunk to several scales. At each scale
the strongest corners (Harris response, local maxima; so many for each area) get an orientation, the direction of
their patch's centroid of brightness, and a descriptor: 256 comparisons of smoothed pixels, at places turned by the
orientation. Descriptors are posted in Hamming tables, each of which takes WORD of their bits, drawn at random, as
its key. Two pictures are candidates if at least two corners on either side share a key. All descriptors of
candidates are then compared: matches differ in at most DIFFERENT bits, every match implies a turn, a scale and a
shift, and the pictures are copies if enough places on either side agree with one of these: AGREEING at least, and
SHARE of the smaller picture's points.

Groups are not expanded into pairs. Every list of a key is first joined to one hub, its smallest picture. Where a
list then holds several components that also meet elsewhere, members outside the hub's component meet another member
of that component; this is done HUBS times. Members that still lie outside then meet all the list's members of other components; if
there are more than SHORT of them, the list's pictures are compared in blocks instead, a task for each pair of blocks,
and whatever links merges its components at once. Each candidate pair is thus compared or already
within one component, so the components are those of all copies. Only the blocks' work grows with the square of the
pictures that share such long lists, which takes lists that are long by chance, not by copies.

Equal files are one picture from the start. Copies form components; each row gets its component's smallest id.

Defined cases: a null, empty or unreadable picture (also one of more than PIXELS) has no points and is linked with
nothing but equal files that are not null; a picture without corners likewise; a null id takes no part and is kept
with a null component; rows of one id are one node, which has all their pictures; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import components
from .shared import record_batch, stash, tidy

#: Scales, and the corners of each for an area of AREA pixels of the whole picture.
SCALES, POINTS, AREA = (1.0, 0.7, 0.5), (32, 14, 8), 6400
MARGIN, RADIUS, BITS, TABLES, WORD = 15, 12, 256, 11, 40
#: Bits by which matching descriptors may differ; places that must agree, and their share of the points; pixels by which they may be off.
DIFFERENT, AGREEING, SHARE, OFF = 64, 6, 0.15, 3.0
#: Rounds of hubs after the first; members outside the hub's component up to which a list is compared in full; pictures of a block, and of a slice of it.
HUBS, SHORT, BLOCK, SLICE = 2, 48, 2048, 8
PIXELS = 1 << 26

_RNG = np.random.default_rng(7)
_R, _A = RADIUS * np.sqrt(_RNG.random((BITS, 2))), 2 * np.pi * _RNG.random((BITS, 2))
_TEST_X, _TEST_Y = _R * np.cos(_A), _R * np.sin(_A)
_DY, _DX = np.mgrid[-7:8, -7:8]
_DISC = (_DX**2 + _DY**2 <= 49).astype(np.float32)
_DRAWN = np.concatenate([_RNG.permutation(BITS)[:WORD] for _ in range(TABLES)])
_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "<u8", (BITS // 64,))])
_PICTURE = "id bigint, file binary, n_points int, m binary"


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a PGM (P5) or PNG picture, or None."""
    try:
        if data and data[:2] == b"P5":
            head = data.split(maxsplit=4)[1:4] if data[2:3].isspace() else []
            w, h, top = (int(x) for x in head)
            body = data[len(data) - w * h :]
            return np.frombuffer(body, np.uint8).reshape(h, w) if top == 255 and 0 < w * h <= PIXELS and len(body) == w * h else None
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, struct.error, zlib.error, IndexError):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        return None
    w, h, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    if not 0 < w * h <= PIXELS:
        return None
    rows = np.frombuffer(zlib.decompressobj().decompress(packed, h * (1 + w * step)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(w, step), axis=0).ravel()
        elif kind in (3, 4):
            for x in range(w * step):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                near = (a + b) // 2 if kind == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line[x] = (line[x] + near) & 255
        above = line & 255
        out[y] = above
    colours = out.reshape(h, w, step)[:, :, : 3 if step >= 3 else 1]
    return colours.mean(axis=2).astype(np.uint8)


def _shrunk(images: np.ndarray, scale: float) -> np.ndarray:
    """(n, h, w) pictures at a scale, bilinear."""
    if scale == 1.0:
        return images
    n, h, w = images.shape
    ys, xs = ((np.arange(int(s * scale)) + 0.5) / scale - 0.5 for s in (h, w))
    y0, x0 = np.clip(ys.astype(int), 0, h - 2), np.clip(xs.astype(int), 0, w - 2)
    fy, fx = (ys - y0).astype(np.float32)[None, :, None], (xs - x0).astype(np.float32)[None, None, :]
    rows = images[:, y0] * (1 - fy) + images[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def _boxed(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        k = 2 * r + 1
        x = (np.take(s, range(k, s.shape[axis]), axis) - np.take(s, range(s.shape[axis] - k), axis)).astype(np.float32) / k
    return x


def describe(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(points (x, y, angle, scale), descriptors (n, 4) of 64 bits) of each of the equally large pictures."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in images]
    area = max(1.0, images.shape[1] * images.shape[2] / AREA)
    for scale, most in zip(SCALES, (round(p * area) for p in POINTS), strict=True):
        g = _shrunk(images.astype(np.float32), scale)
        n, h, w = g.shape
        if min(h, w) <= 2 * MARGIN:
            continue
        smooth = _boxed(g, 1)
        ix, iy = np.gradient(smooth, axis=2), np.gradient(smooth, axis=1)
        xx, yy, xy = (_boxed(a, 2) for a in (ix * ix, iy * iy, ix * iy))
        strong = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strong[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > 1.0
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= strong[:, MARGIN + dy : h - MARGIN + dy, MARGIN + dx : w - MARGIN + dx]
        flat = np.where(peak, inner, 0).reshape(n, -1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, :most]
        of, k = np.nonzero(np.take_along_axis(flat, top, axis=1) > 0)
        if not len(of):
            continue
        y, x = np.divmod(top[of, k], inner.shape[2])
        y, x = y + MARGIN, x + MARGIN
        patch = g[of[:, None, None], y[:, None, None] + _DY, x[:, None, None] + _DX] * _DISC
        angle = np.arctan2((patch * _DY).sum(axis=(1, 2)), (patch * _DX).sum(axis=(1, 2)))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(x[:, None, None] + c * _TEST_X - s * _TEST_Y).astype(int)
        py = np.rint(y[:, None, None] + s * _TEST_X + c * _TEST_Y).astype(int)
        values = _boxed(g, 2)[of[:, None, None], py, px]
        bits = np.packbits(values[:, :, 0] < values[:, :, 1], axis=1).view(np.int64)
        points = np.stack([(x + 0.5) / scale, (y + 0.5) / scale, angle, np.full(len(x), scale)], axis=1)
        ends = np.searchsorted(of, np.arange(n + 1))
        for i in range(n):
            found[i].append((points[ends[i] : ends[i + 1]], bits[ends[i] : ends[i + 1]]))
    return [(np.concatenate([np.zeros((0, 4)), *(p for p, _ in x)]), np.concatenate([np.zeros((0, 4), np.int64), *(b for _, b in x)])) for x in found]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, file, image): each picture's points, as packed records."""
    schema = pa.schema([("id", pa.int64()), ("file", pa.binary()), ("n_points", pa.int32()), ("m", pa.binary())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            packed, shapes = [b""] * part.num_rows, {}
            for i, data in enumerate(part.column(2).to_pylist()):
                if (image := decode(data)) is not None and min(image.shape) > 2 * MARGIN:
                    shapes.setdefault(image.shape, []).append((i, image))
            for group in shapes.values():
                step = max(1, (1 << 18) // group[0][1].size)
                for k in range(0, len(group), step):
                    for (i, _), (points, bits) in zip(group[k : k + step], describe(np.stack([x for _, x in group[k : k + step]]))):
                        own = np.empty(len(points), _POINT)
                        for c, name in enumerate(("x", "y", "angle", "scale")):
                            own[name] = points[:, c]
                        own["bits"] = bits.view(np.uint64)
                        packed[i] = own.tobytes()
            yield record_batch({"id": part.column(0), "file": part.column(1), "n_points": [len(p) // _POINT.itemsize for p in packed], "m": pa.array(packed, pa.binary())}, schema)


def _words(m: bytes) -> np.ndarray:
    """The points' table words, a column for each table."""
    bits = np.unpackbits(np.ascontiguousarray(np.frombuffer(m, _POINT)["bits"]).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    out = np.zeros((len(bits), TABLES, 8), np.uint8)
    out[:, :, : -(-WORD // 8)] = np.packbits(bits[:, _DRAWN].reshape(-1, TABLES, WORD), axis=2)
    return out.view(np.int64)[:, :, 0]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, m): a row for each key of a picture, with the first and last of its corners that have the key."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    table = np.arange(TABLES, dtype=np.int64) << 40
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            words = [_words(m) for m in part.column(1).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            keys = (np.concatenate([np.zeros((0, TABLES), np.int64), *words]) | table).ravel()
            row = np.repeat(np.arange(part.num_rows), n * TABLES)
            corner = np.repeat(np.concatenate([np.zeros(0, np.int32), *(np.arange(k, dtype=np.int32) for k in n)]), TABLES)
            order = np.lexsort((corner, keys, row))
            row, keys, corner = row[order], keys[order], corner[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(row)) - 1
            yield record_batch({"key": keys[heads], "id": part.column(0).to_numpy(zero_copy_only=False)[row[heads]], "first": corner[heads], "last": corner[tails]}, schema)


def agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many places (x, y, angle, scale of matches on either side) fit the turn, scale and shift that one match implies."""
    best = 0
    a, b = left[:, 0] + 1j * left[:, 1], right[:, 0] + 1j * right[:, 1]
    turns = np.exp(1j * (right[:, 2] - left[:, 2])) * (left[:, 3] / right[:, 3])
    for k in range(len(a)):
        fits = np.abs(b[k] + (a - a[k]) * turns[k] - b) <= OFF
        if fits.sum() > best:
            # each place counts once on either side, so more matches may be fewer places
            best = max(best, min(len({(round(p.real), round(p.imag)) for p in side[fits]}) for side in (a, b)))
    return best


def alike(left: bytes, right: bytes, agree: int = AGREEING) -> bool:
    """Whether two pictures, given by their packed points, are copies: they meet at enough corners and enough places agree."""
    p, q = np.frombuffer(left, _POINT), np.frombuffer(right, _POINT)
    if min(len(p), len(q)) < agree:
        return False
    agree = max(agree, SHARE * min(len(p), len(q)))
    a, b = _words(left), _words(right)
    shared = np.zeros((len(p), len(q)), bool)
    for t in range(TABLES):
        shared |= a[:, t, None] == b[None, :, t]
    if min(shared.any(axis=0).sum(), shared.any(axis=1).sum()) < 2:
        return False
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(p), 512):
        apart = np.bitwise_count(p["bits"][lo : lo + 512, None] ^ q["bits"][None]).sum(axis=2)
        rows, columns = np.nonzero(apart <= DIFFERENT)
        x.append(rows + lo)
        y.append(columns)
    x, y = np.concatenate(x), np.concatenate(y)
    if min(len(np.unique(x)), len(np.unique(y))) < agree:
        return False
    sides = [np.stack([s[c][k].astype(float) for c in ("x", "y", "angle", "scale")], axis=1) for s, k in ((p, x), (q, y))]
    return agreeing(*sides) >= agree


def _verified(agree: int):
    """From (a, b, ma, mb): the pairs that are copies."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [alike(x.as_py(), y.as_py(), agree) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(found, pa.bool_()))

    return run


def _block_links(same: bool, left: np.ndarray, ids: np.ndarray, comps: np.ndarray, packed: list[bytes], agree: int) -> list[tuple[int, int]]:
    """Links between components: the pictures in ``left`` against the rest, or all if ``same``."""
    words, comps, links, n = [_words(m) for m in packed], comps.copy(), [], len(ids)
    own = np.repeat(np.arange(n), [len(w) for w in words])
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    words = np.concatenate(words)
    rest = np.arange(len(own)) if same else np.flatnonzero(~left[own])
    orders = [rest[np.argsort(words[rest, t], kind="stable")] for t in range(TABLES)]
    ordered = [words[o, t] for t, o in enumerate(orders)]
    lefts = np.arange(n) if same else np.flatnonzero(left)
    for lo in range(0, len(lefts), SLICE):
        mine = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in lefts[lo : lo + SLICE]])
        met = []
        for t in range(TABLES):
            begin, end = (np.searchsorted(ordered[t], words[mine, t], side) for side in ("left", "right"))
            count = end - begin
            p = np.repeat(mine, count)
            q = orders[t][np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
            may = comps[own[p]] != comps[own[q]]
            if same:
                may &= own[q] > own[p]
            met.append(np.stack([p[may], q[may]], axis=1))
        met = np.concatenate(met)
        pair = own[met[:, 0]] * n + own[met[:, 1]]
        # a pair of pictures stays if it meets at two corners on either side
        corners = [np.unique(np.stack([pair, met[:, k]], axis=1), axis=0)[:, 0] for k in (0, 1)]
        (some, c), (_, d) = (np.unique(x, return_counts=True) for x in corners)
        for both in some[np.minimum(c, d) >= 2]:
            x, y = divmod(int(both), n)
            if comps[x] != comps[y] and alike(packed[x], packed[y], agree):
                links.append((int(ids[x]), int(ids[y])))
                comps[comps == comps[y]] = comps[x]
    return links


def _in_blocks(agree: int):
    """From (i, j, id, block, comp, m) sorted by (i, j): links between the components of pictures that meet there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            i, j, ids, block, comps = (rows.column(c).to_numpy() for c in ("i", "j", "id", "block", "comp"))
            made = _block_links(i[0] == j[0], block == i[0], ids, comps, rows.column("m").to_pylist(), agree)
            return record_batch({"a": [min(x) for x in made], "b": [max(x) for x in made]}, schema)

        key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if key is not None and tuple(keys[lo]) != key:
                        yield links()
                    key = tuple(keys[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield links()

    return run


def _merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after further links."""
    return components(comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))


def _links(met: DataFrame, pictures: DataFrame, agree: int) -> DataFrame:
    """The copies among pairs that meet: ``met`` has a row for each key that a and b share, with the range of either's corners, or of b's alone."""
    enough = F.min("b_first") < F.max("b_last")
    if "a_first" in met.columns:
        enough &= F.min("a_first") < F.max("a_last")
    pairs = stash(met.groupBy("a", "b").agg(enough.alias("enough")).where("enough").select("a", "b"), "pairs")
    # what is written has a known size: Spark broadcasts it if it is small, else both sides are shuffled
    ends = stash(pictures.toDF("a", "ma").join(pairs.select("a"), "a", "left_semi"), "ends")
    both = pictures.toDF("b", "mb").join(pairs, "b").join(ends, "a")
    return stash(both.select("a", "b", "ma", "mb").mapInArrow(tidy(_verified(agree)), "a long, b long"), "links")


def _blocks(pictures: DataFrame, tagged: DataFrame, long: DataFrame, comps: DataFrame, agree: int) -> DataFrame | None:
    """(a, b): links between components whose pictures share the lists in ``long``."""
    named = comps.toDF("id", "comp")
    members = tagged.join(long, "key", "left_semi").select("key", "id").join(named, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    here = stash(members.join(mixed, "key", "left_semi").select("id", "comp").distinct(), "members")
    n = -(-here.count() // BLOCK)
    if not n:
        return None
    dealt = pictures.select("id", "m").join(here, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", F.col("block").cast("long"), "comp", "m")
    dealt = dealt.repartition(n * (n + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "id")
    return stash(dealt.mapInArrow(tidy(_in_blocks(agree)), "a long, b long"), "links")


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of lists whose components may hold a candidate pair: ``shared`` with ``comp`` and ``main``, the component of the list's hub.

    Components that meet in a list are counted first, by the range of either's corners, as if each were one picture.
    Where that gives one corner only, no two pictures of theirs have two. Lists of many components stay as they are.
    """
    named = shared.join(comps.toDF("id", "comp"), "id", "left").join(comps.toDF("hub", "main"), "hub", "left")
    named = named.select(*shared.columns, F.coalesce("comp", "id").alias("comp"), F.coalesce("main", "hub").alias("main"))
    mixed = named.groupBy("key").agg(F.bool_or(F.col("comp") != F.col("main")).alias("mixed")).where("mixed").select("key")
    named = stash(named.join(mixed, "key", "left_semi"), "mixed")
    parts = named.groupBy("key", "comp").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    many = parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select("key")
    side = lambda name: [F.col("comp").alias(name), F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last")]
    few = parts.join(many, "key", "left_anti")
    met = stash(few.select("key", *side("a")).join(few.select("key", *side("b")), "key").where("a < b"), "met")
    enough = met.groupBy("a", "b").agg(((F.min("a_first") < F.max("a_last")) & (F.min("b_first") < F.max("b_last"))).alias("enough")).where("enough")
    kept = met.join(enough.select("a", "b"), ["a", "b"]).select("key", F.explode(F.array("a", "b")).alias("comp")).distinct()
    kept = stash(kept.unionByName(parts.join(many, "key", "left_semi").select("key", "comp")), "kept")
    return stash(named.join(kept, ["key", "comp"], "left_semi").select(*shared.columns, "comp", "main"), "tagged")


def copies(media: DataFrame, id_col: str, image_col: str, agree: int = AGREEING) -> DataFrame:
    """(id, n_points, component_id, kept) of each row."""
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast("binary").alias("image"))
    described = rows.select("id", F.unhex(F.sha2("image", 256)).alias("file"), "image").mapInArrow(tidy(_described), _PICTURE)
    described = stash(described.withColumn("row", F.monotonically_increasing_id()), "described")
    files = described.where("id IS NOT NULL AND file IS NOT NULL").select("id", "file", "row", "n_points")
    reps = files.groupBy("file").agg(F.min(F.struct("id", "row")).alias("rep")).select("file", F.col("rep.id").alias("rep"), F.col("rep.row").alias("own"))
    again = stash(files.join(reps, "file").where("row <> own").select("id", "row", "rep"), "again")
    same = again.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    pictures = described.where((F.col("n_points") >= agree) & F.col("id").isNotNull())
    if not again.isEmpty():
        pictures = stash(pictures.join(again.select("row"), "row", "left_anti").select("id", "m"), "pictures")
    pictures = pictures.select("id", "m")

    posts = pictures.mapInArrow(tidy(_postings), "key bigint, id bigint, first int, last int")
    lists = stash(posts.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").select("key", "hub"), "lists")
    shared = stash(posts.join(lists, "key"), "shared")
    side = lambda name: [F.col("id").alias(name), F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last")]

    # every member with its list's hub, which its row names, so that no join is needed: alike() counts the hub's corners;
    # then, in lists of several components, members outside the hub's with another of it
    found = _links(shared.where("id <> hub").select(F.col("hub").alias("a"), *side("b")), pictures, agree)
    comps = stash(components(found.unionByName(same)), "components")
    tagged = _mixed(shared, comps)
    for turn in range(HUBS):
        hubs = tagged.where("comp = main").groupBy("key").agg(F.min_by(F.struct(*side("a")), F.xxhash64("id", F.lit(turn))).alias("h")).select("key", "h.*")
        found = _links(tagged.where("comp <> main").select("key", *side("b")).join(hubs, "key"), pictures, agree)
        if found.isEmpty():
            break
        comps = stash(_merged(comps, found), "components")
        tagged = _mixed(tagged.select(shared.columns), comps)

    # then members that are still outside with all members of other components
    sizes = tagged.where("comp <> main").groupBy("key").agg(F.count("*").alias("n"))
    long = sizes.where(F.col("n") > SHORT).select("key")
    others = tagged.where("comp <> main").join(sizes.where(F.col("n") <= SHORT).select("key"), "key", "left_semi").select("key", F.col("comp").alias("other"), *side("a"))
    met = others.join(tagged.select("key", "comp", *side("b")), "key").where("comp <> other")
    swapped = met.select(*[F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in ((f"{p}{c}", f"{q}{c}") for p, q in ("ab", "ba") for c in ("", "_first", "_last"))])
    more = _links(swapped, pictures, agree)
    if not more.isEmpty():
        comps = stash(_merged(comps, more), "components")
    if not long.isEmpty() and (last := _blocks(pictures, tagged, long, comps, agree)) is not None and not last.isEmpty():
        comps = stash(_merged(comps, last), "components")

    sizes = files.groupBy("id").agg(F.max("n_points").alias("n_points"))
    out = described.select("id").join(comps.toDF("id", "comp"), "id", "left").join(sizes, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select("id", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _waves(n: int, side: int) -> np.ndarray:
    """n plane waves over a square, spread evenly over directions, periods of 7 to 14 pixels, and phases."""
    k = np.arange(n)[:, None, None]
    turn, period, phase = np.pi * (k * 0.6180339887498949 % 1), 7 * 2 ** (k * 0.7548776662466927 % 1), 2 * np.pi * (k * 0.5698402909980532 % 1)
    y, x = np.mgrid[0:side, 0:side]
    return np.cos(2 * np.pi * (np.cos(turn) * x + np.sin(turn) * y) / period + phase).reshape(n, -1)


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 80) -> DataFrame:
    """(id, image): a PGM picture of each vector, the sum of one plane wave for each component; null where the vector is null or empty.

    Components that are null or not finite count as zero; only a vector's direction matters, not its length.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waves: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, images = batch.slice(lo, 256), []
                for v in part.column(1).to_pylist():
                    if not v:
                        images.append(None)
                        continue
                    x = np.nan_to_num(np.array([0 if c is None else c for c in v], float), posinf=0, neginf=0)
                    if len(x) not in waves:
                        waves[len(x)] = _waves(len(x), side)
                    x /= max(np.abs(x).max(), 1e-300)
                    picture = np.clip(128 + 60 * (x / max(np.linalg.norm(x), 1e-300) @ waves[len(x)]), 0, 255).astype(np.uint8)
                    images.append(b"P5 %d %d 255\n" % (side, side) + picture.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], names=[id_col, "image"])

    return vectors.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, f"`{id_col}` {kind}, image binary")
