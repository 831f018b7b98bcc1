"""Readers by suffix; every record source also gives ``raw``, the record as JSON text, on request."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import html_text

STRUCTURED = (".jsonl", ".csv", ".json", ".parquet", ".xml")
PAGES = (".html", ".htm")
TEXTS = (".txt", ".md")


def mode_of(path: str) -> str:
    """``structured`` or ``text``, by the suffix."""
    return "structured" if PurePosixPath(path).suffix.lower() in STRUCTURED else "text"


def unknown(path: str) -> bool:
    """Whether no reader is made for the suffix; such files are texts unless a parser is written for them."""
    return PurePosixPath(path).suffix.lower() not in (*STRUCTURED, *PAGES, *TEXTS)


def jsonl_raw(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of each line that isn't blank."""
    return spark.read.text(path).select(F.trim("value").alias("raw")).where("raw <> ''")


def valid_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows whose raw text is a JSON object."""
    v = F.try_parse_json(raw)
    return df.where(v.isNotNull() & F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("null")))).startswith("OBJECT"))


def json_raw(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of each item of an array, or of the one object."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t")).where("t <> ''")
    items = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.array("t"))
    return text.select(F.explode(items).alias("raw"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; blanks are empty strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; HTML becomes its readable text."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("text", F.when(F.lower("path").rlike(r"\.html?$"), html_text(F.col("text"))).otherwise(F.col("text")))


def open_dataset(spark: SparkSession, path: str, mode: str = "auto", row_tag: str = "item") -> DataFrame:
    """The table behind a path; ``mode`` text reads any file as documents."""
    suffix = PurePosixPath(path).suffix.lower()
    if mode == "text" or (mode == "auto" and mode_of(path) == "text"):
        return documents(spark, path)
    if suffix == ".jsonl":
        return spark.read.json(path)
    if suffix == ".json":
        return spark.read.option("multiLine", True).json(path)
    if suffix == ".csv":
        return csv(spark, path)
    if suffix == ".xml":
        return spark.read.option("rowTag", row_tag).xml(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no structured reader for {suffix or path}")


def parsed_by(spark: SparkSession, path: str, code: str, name: str = "parse_file") -> DataFrame:
    """(file, row, raw) of the records that a guarded function ``name(text) -> list of records`` finds in each file."""
    import json

    from ..operators.rules import PyRule

    rule = PyRule(name, code)
    rule.compiled()

    @F.udf("array<string>")
    def run(text: str):
        found = rule.compiled()(text)
        if not isinstance(found, list) or not all(isinstance(r, dict) for r in found):
            raise TypeError(f"{name} must return a list of dicts")
        return [json.dumps(r, ensure_ascii=False) for r in found]

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), run("value").alias("rows"))
    return files.select("file", F.posexplode("rows").alias("row", "raw"))
