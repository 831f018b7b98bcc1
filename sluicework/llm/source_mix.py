"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Each document draws a number u from a hash of its id and gets the exponential key -ln(u) / quality, where the quality
weight is the share of its characters that are no marks or digits. A source's target is met by complete epochs first
(every document once, twice, ...), then by a fraction: its documents in the order of their keys, as long as the
running sum of sizes stays within what is left of the target. The document at the edge is taken if that comes closer.

No source is ever sorted as a whole: sizes are summed by (source, range of keys) first, the running sum over ranges
finds the range that holds the edge, and only documents of that range are sorted. What results is one limit for each
source, with which every document decides for itself.

Defined cases: a null, empty or blank text has size 0 and is taken with its neighbours by key, at most ``most`` times, or
not at all if its source has no words; a null source is a source of its own, the last; documents without id
draw by a hash of their text; rows with the same id (or no id and the same text) and size are taken together; an
empty table gives an empty result; further columns are kept by ``mixed`` and ignored by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, stash

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Ranges of keys for each source, and the number of sources up to which their limits are broadcast.
RANGES, FEW_SOURCES = 4096, 10_000

_MARKS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"
_KEY = "struct<key:double,tie:string,size:bigint>"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with __source, __size and __key (key, tie, size)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    length = F.length(text)
    quality = F.greatest(F.lit(0.01), (length - F.regexp_count(text, F.lit(_MARKS))) / F.greatest(length, F.lit(1)))
    tie = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(text.cast("binary"))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), tie).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    out = docs.withColumns({"__source": F.col(source_col).cast("string"), "__size": size, "__tie": tie})
    return out.withColumn("__key", F.struct((-F.log(u) / quality).alias("key"), F.col("__tie").alias("tie"), F.col("__size").alias("size"))).drop("__tie")


def _range() -> Column:
    """The range of a key: never falls as the key rises."""
    return F.floor((1 - F.exp(-F.col("__key.key"))) * RANGES).cast("int")


def limits(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """By source: source_size, target, epochs, and the range and key up to which documents are taken once more."""
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    by_name = Window.orderBy(F.col("__source").isNull(), "__source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filled = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("want", share * F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("__source").isNull(), "__source")
    past = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = filled.withColumn("level", (F.col("want") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(fill))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    level = F.min(F.when(~full, F.struct("place", "level"))).over(Window.partitionBy())["level"]
    targets = filled.withColumn("target", F.when(full, F.col("cap")).otherwise(level * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stash(targets.select("__source", "source_size", "target", epochs.alias("epochs")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    sums = rows.groupBy("__source", _range().alias("range")).agg(F.sum("__size").alias("s"))
    run = Window.partitionBy("__source").orderBy("range")
    sums = sums.withColumn("ahead", F.sum("s").over(run) - F.col("s")).withColumnRenamed("__source", "named")
    edge = sums.join(targets, F.col("named").eqNullSafe(F.col("__source"))).where("left > 0 AND ahead <= left AND left < ahead + s")
    edges = stash(edge.select("named", F.col("range").alias("edge"), "ahead", "left"), "edges")

    near = _with(rows.withColumn("range", _range()), edges, "named").where("range = edge")
    order = Window.partitionBy("__source").orderBy("__key.key", "__key.tie", "__key.size")
    near = near.withColumn("end", F.col("ahead") + F.sum("__size").over(order))
    last = near.where("end - __size / 2 <= left").groupBy("named").agg(F.max("__key").alias("last"))
    found = edges.select("named", "edge").join(last.withColumnRenamed("named", "of"), F.col("named").eqNullSafe(F.col("of")), "left").drop("of")
    return stash(targets.drop("left").join(found, F.col("__source").eqNullSafe(F.col("named")), "left").drop("named").withColumnRenamed("__source", "__named"), "limits")


def _with(rows: DataFrame, plan: DataFrame, named: str) -> DataFrame:
    """Rows with their source's plan: broadcast if the sources are few, else an ordinary join."""
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(plan) if few else plan, F.col("__source").eqNullSafe(F.col(named)), "left")


def _copies() -> Column:
    once_more = (F.col("__range") < F.col("edge")) | ((F.col("__range") == F.col("edge")) & (F.col("__key") <= F.col("last")))
    return F.col("epochs") + F.coalesce(once_more, F.lit(False)).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each document."""
    rows = sized(docs.select(F.col(id_col), F.col(text_col), F.col(source_col)), id_col, text_col, source_col)
    rows = stash(rows.select(id_col, "__source", "__size", "__key"), "sizes")
    out = _with(rows.withColumn("__range", _range()), limits(rows, **options), "__named").withColumn("copies", _copies())
    return out.select(id_col, F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each document as often as it is taken, with all its columns."""
    rows = sized(docs, id_col, text_col, source_col)
    plan = limits(stash(rows.select("__source", "__size", "__key"), "sizes"), **options)
    taken = _with(rows.withColumn("__range", _range()), plan, "__named").withColumn("__copies", _copies()).where("__copies > 0")
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return taken.select(docs.columns)


def mixture_sql() -> str:
    """The rows of ``mixture`` over documents, in DuckDB SQL."""
    return rf"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    greatest(0.01::DOUBLE, (length(text) - len(regexp_extract_all(text, '{_MARKS}')))::DOUBLE / greatest(length(text), 1)) AS quality,
    coalesce(CAST(doc_id AS VARCHAR), '-' || md5(text)) AS tie FROM texts),
keyed AS (SELECT *, -ln((CAST('0x' || substr(md5('mix|' || tie), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ()) AS want FROM sources),
filled AS (
  SELECT *, row_number() OVER w AS place,
    (want - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (
  SELECT *, CASE WHEN level * weight >= cap THEN cap
    ELSE (SELECT f.level FROM filled f WHERE f.level * f.weight < f.cap ORDER BY f.place LIMIT 1) * weight END AS target FROM filled),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
run AS (
  SELECT k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS room,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_at
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken
FROM (SELECT *, CAST(epochs + CASE WHEN room > 0 AND end_at - size / 2 <= room THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run)"""
