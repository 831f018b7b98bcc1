"""MinHash near-dedup by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of ``coordinates`` minima. Documents are posted under each
(coordinate, value) pair. Two documents are candidates if they collide in at least ``matches`` coordinates.
Counting collisions skips long lists: a document's postings are ordered by list length, and only the prefix of
the rarest ones is merged, since any pair with enough collisions meets there; the rest of the signature is
compared pair by pair. Candidates are confirmed on full shingle sets.

Groups are never expanded into all pairs. Each list first links its members to one hub, by a join on the few pairs
that this gives. Where the members of a hub then still lie in several components, those outside its largest one meet all
members in pairs of blocks of bounded size: members of different components are compared, by signatures and then on
full sets, and whatever links merges their components at once, so a block sends at most one link for each member. Every candidate pair is confirmed,
refuted, or already within one component, so components are those of all candidate links. A pair is also refuted
if the exact Jaccard distances of its two members to the hub differ by more than the linking distance: that distance
is a metric.

Defined cases: a null or empty text has no shingles and links with nothing; a row without id links with nothing
and is kept with a null component; rows of one id count as one document; equal sets are linked by their 128-bit
fingerprints; further columns are ignored. A pair at a similarity of exactly 0.75 misses the match threshold with
a probability of about 1e-5 (binomial tail, 64 coordinates, 33 matches); more similar pairs, far less. Words and
shingles are compared by 64-bit hashes that mix after every 8 bytes and every word, so regular words don't collide.
Ties: a group is named by its smallest id. A long text is read in windows; its words, shingles and set take some 30
bytes a word next to the text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, random_words, record_batch, stash, text_slices, tidy, word_hashes

COORDINATES, MATCHES, SHINGLE = 64, 33, 5
PERCENT = 75
#: Members of one hub, and shingles of all of them, that form one block.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Shingles handled at once.
PART = 1 << 20

_PLACES = random_words(64, 5)
_FLIPS, _FACTORS = random_words(256, 7), random_words(256, 9)


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of the texts one after another, number before each text); repeats are kept."""
    words, before, _ = word_hashes(data, offsets)
    counts = np.diff(before)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ahead = np.concatenate([[0], np.cumsum(n)])
    rolled = np.empty(max(0, len(words) - size + 1), np.uint64)
    for lo in range(0, len(rolled), PART):
        hi = min(lo + PART, len(rolled))
        own = np.zeros(hi - lo, np.uint64)
        for j in range(size):  # each step mixes, so that no sum of words cancels
            own = mix64((own ^ words[lo + j : hi + j]) * _PLACES[j])
        rolled[lo:hi] = own
    if len(counts) == 1 and counts[0] >= size:
        return rolled, ahead
    out = np.empty(ahead[-1], np.uint64)
    at = np.arange(ahead[-1]) - np.repeat(ahead[:-1], n) + np.repeat(before[:-1], n)
    full = np.repeat(counts >= size, n)
    out[full] = rolled[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = np.uint64(counts[i])
        for j, word in enumerate(words[before[i] : before[i + 1], None]):
            own = mix64((own ^ word) * _PLACES[8 + j])
        out[ahead[i]] = own[0]
    return out, ahead


def _signatures(shingles: np.ndarray, ahead: np.ndarray, coordinates: int) -> np.ndarray:
    """uint32 minima, a row for each text that has shingles."""
    starts = ahead[:-1][np.diff(ahead) > 0]
    out = np.full((len(starts), coordinates), np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(shingles), PART):
        part = shingles[lo : lo + PART]
        first = max(0, int(np.searchsorted(starts, lo, "right")) - 1)
        last = int(np.searchsorted(starts, lo + len(part), "left"))
        cuts = np.maximum(starts[first:last] - lo, 0)
        for k in range(coordinates):
            least = np.minimum.reduceat((part ^ _FLIPS[k]) * _FACTORS[k], cuts) >> np.uint64(32)
            out[first:last, k] = np.minimum(out[first:last, k], least)
    return out


def _prints(size: int, coordinates: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, ahead = _shingles(data, offsets, size)
                sig = _signatures(hashes, ahead, coordinates).view(np.int32)
                n, f1, f2 = (np.zeros(hi - lo, np.uint64) for _ in range(3))
                for i in range(hi - lo):
                    own = np.unique(hashes[ahead[i] : ahead[i + 1]])
                    n[i], (f1[i], f2[i]) = len(own), _fingerprint(own)
                has = np.concatenate([[0], np.cumsum(np.diff(ahead) > 0)]) * coordinates
                yield record_batch({"id": batch.column(0).slice(lo, hi - lo), "n_shingles": n.view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64), "sig": pa.ListArray.from_arrays(has.astype(np.int32), pa.array(sig.ravel()))}, schema)

    return run


def _fingerprint(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return own.sum(dtype=np.uint64), mix64(own ^ _FLIPS[200]).sum(dtype=np.uint64)


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, ahead = _shingles(data, offsets, size)
                own = [np.unique(hashes[ahead[i] : ahead[i + 1]]) for i in range(hi - lo)]
                n = np.array([len(x) for x in own], np.int64)
                f1, f2 = np.array([_fingerprint(x) for x in own], np.uint64).T.copy()
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield record_batch({"id": batch.column(0).slice(lo, hi - lo), "n_shingles": n, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "set": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64)))}, schema)

    return run


def _block_links(same: bool, left: np.ndarray, ids: np.ndarray, comps: np.ndarray, far: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], matches: int, percent: int) -> list[tuple[int, int]]:
    """Links between components of the members of one hub: members in ``left`` against the rest, or all if ``same``."""
    sizes = np.array([len(x) for x in sets])
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(codes.max() + 1, bool)
    comps, most, links = comps.copy(), 1 - percent / 100 + 1e-9, []
    for x in range(len(ids)) if same else np.flatnonzero(left):
        may = (comps != comps[x]) & ~(np.abs(far - far[x]) > most)
        if same:
            may[:x] = False
        else:
            may &= ~left
        may &= 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        at = np.flatnonzero(may)
        at = at[(sigs[at] == sigs[x]).sum(axis=1) >= matches]
        if not len(at):
            continue
        own = codes[heads[x] : heads[x] + sizes[x]]
        held[own] = True
        common = np.add.reduceat(held[codes].astype(np.int32), heads)[at]
        held[own] = False
        for y in at[100 * common >= percent * (sizes[at] + sizes[x] - common)]:
            if comps[y] != comps[x]:
                links.append((int(ids[x]), int(ids[y])))
                comps[comps == comps[y]] = comps[x]
    return links


def _in_blocks(matches: int, percent: int):
    """From rows sorted by (hub, i, j): links between the components that meet there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, block, comps, far = (rows.column(c).to_numpy() for c in ("node", "block", "comp", "far"))
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            sets = [x.values.to_numpy() for x in rows.column("set")]
            sigs = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            made = _block_links(i == j, block == i, ids, comps, far, sigs, sets, matches, percent) if len(ids) > 1 else []
            return record_batch({"a": [min(x) for x in made], "b": [max(x) for x in made]}, schema)

        key = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
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


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``edges`` (a, b); alternating large and small stars."""
    cut = lambda df: stash(df.distinct(), "stars")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        # large now points from smaller to larger: a small star moves each node's smaller neighbours to the smallest
        small = large.join(low, large["b"] == low["u"]).select(F.col("m").alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
        moved = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        edges = cut(moved)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


_SET = ["f1", "f2", "n_shingles"]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, matches: int = MATCHES, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``; see the module's text."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = stash(source.mapInArrow(tidy(_prints(shingle, coordinates)), "id long, n_shingles long, f1 long, f2 long, sig array<int>"), "prints")
    whole = prints.where("id IS NOT NULL AND n_shingles > 0")
    by_id = whole.groupBy("id").agg(F.count("*").alias("c"), F.min("f1").alias("x"), F.max("f1").alias("y"))
    repeated, several = by_id.agg(F.coalesce(F.max(F.col("c") > 1), F.lit(False)), F.coalesce(F.max(F.col("x") != F.col("y")), F.lit(False))).first()

    # A class holds the rows of one set. Its node is its smallest id; where an id has several sets, a hash of the set.
    node = F.xxhash64(*_SET) if several else F.col("low")
    classes = stash(whole.groupBy(*_SET).agg(F.min("id").alias("low"), F.first("sig").alias("sig")).withColumn("node", node), "classes")
    sigs = classes.select("node", "sig")

    tokens = classes.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("tok"))
    lengths = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(lengths, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("p")).where(F.size("p") >= matches)
    # Of c shared coordinates, two documents with enough collisions have one of the c - matches + 1 rarest in common.
    posts = stash(own.select("node", F.explode(F.slice("p", F.lit(1), F.size("p") - F.lit(matches - 1))).alias("t")).select("node", F.col("t.tok").alias("tok")), "posts")

    hubs = posts.groupBy("tok").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    pairs = posts.join(hubs, "tok").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    pairs = stash(pairs.where(F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= matches).select("a", "b"), "pairs")

    # Full sets of the documents that share a list.
    partners = stash(posts.join(hubs, "tok", "left_semi").select("node").distinct(), "partners")
    texts = source.join(partners.join(classes, "node").select(F.col("low").alias("id")).distinct(), "id", "left_semi")
    sets = texts.mapInArrow(tidy(_sets(shingle)), "id long, n_shingles long, f1 long, f2 long, set array<bigint>")
    sets = sets.select(F.xxhash64(*_SET).alias("node") if several else F.col("id").alias("node"), "set")
    if several:
        sets = sets.join(partners, "node", "left_semi")
    sets = stash(sets.dropDuplicates(["node"]) if repeated else sets, "sets")

    def compare(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
        return both.select("a", "b", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("all"))

    linked = 100 * F.col("common") >= percent * F.col("all")
    measured = stash(compare(pairs), "measured")
    found = measured.where(linked).select("a", "b")
    to_hub = measured.select(F.col("a").alias("hub"), F.col("b").alias("node"), (1 - F.col("common") / F.col("all")).alias("far"))
    if several:  # classes that an id has in common
        ids = whole.join(classes.select(*_SET, "node"), _SET).groupBy("id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
        found = found.unionByName(ids.select("a", F.explode("all").alias("b")).where("a <> b"))
    comps = components(found)

    members = posts.join(hubs.select("tok", "hub"), "tok").select("hub", "node").distinct().join(comps, "node", "left").select("hub", "node", F.coalesce("comp", "node").alias("comp"))
    members = stash(members.join(classes.select("node", "n_shingles"), "node"), "members")
    # A hub's largest component needs no comparison within itself: only what lies outside of it meets all the others.
    parts = members.groupBy("hub", "comp").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    largest = F.max(F.struct("c", F.col("comp").alias("main"), F.col("s").alias("w"))).alias("m")
    mixed = parts.groupBy("hub").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), largest).where("c > m.c")
    deal = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("long")
    mixed = stash(mixed.select("hub", "m.main", deal(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.w")).alias("no"), deal(F.col("m.c"), F.col("m.w")).alias("nm")), "mixed")  # of known size: broadcast if small, so that a hot hub stays spread
    dealt = members.join(mixed, "hub").join(to_hub, ["hub", "node"], "left")
    far = F.when(F.col("hub") == F.col("node"), 0.0).otherwise(F.coalesce("far", F.lit(float("nan"))))
    inner = F.col("comp") == F.col("main")
    dealt = dealt.withColumn("far", far).withColumn("block", F.when(inner, F.col("no") + F.pmod(F.xxhash64("node"), F.col("nm"))).otherwise(F.pmod(F.xxhash64("node"), F.col("no"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inner, F.col("no")).otherwise(F.col("no") + F.col("nm")) - 1)))
    dealt = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "comp", "far").join(sigs, "node").join(sets, "node")
    dealt = dealt.select("hub", "i", "j", "node", "block", "comp", "far", "sig", "set").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "node")
    more = stash(dealt.mapInArrow(tidy(_in_blocks(matches, percent)), "a long, b long"), "links")
    if not more.isEmpty():
        comps = components(comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))

    named = classes.join(comps, "node", "left").select("f1", "f2", F.col("n_shingles").alias("n"), "low", F.coalesce("comp", "node").alias("comp"))
    if several:
        named = named.join(named.groupBy("comp").agg(F.min("low").alias("least")), "comp").select("f1", "f2", "n", F.col("least").alias("comp"))
    out = prints.select("id", *_SET).join(named.withColumnsRenamed({"f1": "g1", "f2": "g2"}), F.expr("f1 = g1 AND f2 = g2 AND n_shingles = n AND id IS NOT NULL"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns; of repeated rows of an id, one: the smallest text by hash."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("__kept")).distinct()
    rows = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
    again = stash(rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again"), "again")
    if again.isEmpty():
        return rows
    repeated = F.col(id_col).isNotNull() & (F.col(id_col) == F.col("__again"))
    once = rows.join(again, repeated, "left_anti")
    rest = rows.join(again, F.col(id_col) == F.col("__again"), "left_semi").withColumn("__order", F.xxhash64(F.col(text_col).cast("string"), *[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]))
    first = rest.groupBy(F.col(id_col).alias("__first")).agg(F.min("__order").alias("__least"))
    rest = rest.join(first, (F.col(id_col) == F.col("__first")) & (F.col("__order") == F.col("__least"))).select(docs.columns).dropDuplicates([id_col])
    return once.unionByName(rest)


def near_duplicates_sql(percent: int = PERCENT, shingle: int = SHINGLE) -> str:
    """The rows of ``near_duplicates`` over documents, in DuckDB SQL: shared shingles, then reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM lists),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= {percent} * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM lists JOIN least USING (doc_id)"""
