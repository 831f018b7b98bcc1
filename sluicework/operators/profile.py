"""Profiling: schema inference, quality profiles, comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"string": "str", "boolean": "bool"}


def kind(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.StructType, T.MapType)):
        return "dict"
    return KINDS.get(t.simpleString(), "unknown")


def _long(df: DataFrame, wide: dict[str, list[Column]], names: list[str], kinds: list[str]) -> DataFrame:
    """One aggregate over all fields in a single pass, turned into a row for each field."""
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("field"), *[c.cast(k).alias(n) for c, n, k in zip(cols, names, kinds, strict=True)]) for i, (f, cols) in enumerate(wide.items())]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quality_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(field, null_count, empty_string_count, unique_count, total_records); null counts as a value."""
    wide = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        value = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType, T.VariantType)) else c
        empty = F.count_if(c == "") if isinstance(f.dataType, T.StringType) else F.lit(0)
        unique = (F.approx_count_distinct(value) if approximate else F.count_distinct(value)) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
        wide[f.name] = [F.count_if(c.isNull()), empty, unique, F.count(F.lit(1))]
    names = ["null_count", "empty_string_count", "unique_count", "total_records"]
    return _long(df, wide, names, ["long"] * 4).drop("ordinal")


def totals(profile: DataFrame) -> DataFrame:
    return profile.agg(F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_count"), F.coalesce(F.sum("empty_string_count"), F.lit(0)).alias("empty_string_count"), F.coalesce(F.max("total_records"), F.lit(0)).alias("total_records"))


def _reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) * 100.0 / before, 2)).otherwise(F.lit(0.0))


def quality_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Profiles of both side by side, for the union of their fields, with reductions in per cent."""
    b, a = (p.select("field", *[F.col(c).alias(f"{c}_{side}") for c in ("null_count", "empty_string_count", "unique_count")]) for p, side in ((quality_profile(before), "before"), (quality_profile(after), "after")))
    joined = b.join(a, "field", "full_outer").na.fill(0)
    return joined.withColumn("null_reduction_pct", _reduction(F.col("null_count_before"), F.col("null_count_after"))).withColumn("empty_string_reduction_pct", _reduction(F.col("empty_string_count_before"), F.col("empty_string_count_after")))


def schema_profile(df: DataFrame, order: str, sample_size: int = 10) -> DataFrame:
    """(ordinal, field, type, nullable, samples) from the first rows in ``order``: up to three non-null samples each."""
    head = df.orderBy(order).limit(sample_size)
    wide = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        seen = F.transform(F.slice(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(order).alias("p"), c.cast("string").alias("v"))))), 1, 3), lambda x: x["v"])
        wide[f.name] = [F.when(F.count(c) > 0, F.lit(kind(f.dataType))).otherwise("unknown"), F.coalesce(F.bool_or(c.isNull()), F.lit(False)), seen]
    return _long(head, wide, ["type", "nullable", "samples"], ["string", "boolean", "array<string>"])


def json_schema_profile(raw: DataFrame, raw_col: str, order: str, sample_size: int = 10) -> DataFrame:
    """The same for JSON records of changing shape: absent keys are no nulls, several types make ``mixed``."""
    head = raw.select(F.col(order).alias("p"), F.try_parse_json(raw_col).alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'").orderBy("p").limit(sample_size)
    view = f"__head_{uuid.uuid4().hex}"
    head.createTempView(view)
    cells = raw.sparkSession.sql(f"SELECT p, e.pos, e.key AS field, e.value AS value FROM {view}, LATERAL variant_explode(v) AS e")
    raw.sparkSession.catalog.dropTempView(view)
    name = F.schema_of_variant("value")
    which = F.when(name == "VOID", None).when(name == "STRING", "str").when(name == "BOOLEAN", "bool").when(name == "BIGINT", "int").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "dict").otherwise("unknown")
    cells = cells.select("p", "pos", "field", which.alias("kind"), F.is_variant_null("value").alias("null"), F.to_json("value").alias("text"))
    kinds = F.collect_set("kind")
    seen = F.transform(F.slice(F.array_sort(F.collect_list(F.when(~F.col("null"), F.struct("p", "text")))), 1, 3), lambda x: x["text"])
    out = cells.groupBy("field").agg(F.min(F.struct("p", "pos")).alias("first"), F.when(F.size(kinds) == 0, "unknown").when(F.size(kinds) > 1, "mixed").otherwise(F.element_at(kinds, 1)).alias("type"), F.bool_or("null").alias("nullable"), seen.alias("samples"))
    return out.orderBy("first").drop("first")


def schema_text(rows: list) -> str:
    """A prompt's description of an inferred schema: a line for each field."""
    shown = lambda r: ", ".join(repr(s) if r["type"] == "str" else str(s) for s in r["samples"])
    return "\n".join(f"- {r['field']}: {r['type']}{' (nullable)' if r['nullable'] else ''} e.g. {shown(r) or 'no samples'}" for r in rows)


def latency_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, total, least, most and mean by group, rounded to two places."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n_calls"), *[F.round(F.coalesce(f(v), F.lit(0.0)), 2).alias(n) for f, n in ((F.sum, "total"), (F.min, "least"), (F.max, "most"), (F.avg, "mean"))])


def format_change(before: int, after: int) -> str:
    """A report's cell for a change."""
    if before == 0:
        return "-" if after == 0 else f"+{after}"
    change = (after - before) * 100 / before
    return "0%" if change == 0 else f"{change:+.1f}%"
