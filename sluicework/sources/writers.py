"""Writers by suffix."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = (".txt", ".md", ".html", ".htm")


def default_output(path: str) -> str:
    """``x.csv`` -> ``x.cleaned.csv``; texts become Markdown."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}.cleaned{'.md' if p.suffix.lower() in TEXT else p.suffix}"))


def write_json_arrays(df: DataFrame, path: str, raw: str = "raw") -> None:
    """JSON records as a folder of files, each an array with a record on each line; empty partitions give empty arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        held = None
        for batch in batches:
            rows = ([] if held is None else [held]) + batch[raw].tolist()
            if rows:
                held = rows.pop()
                yield pd.DataFrame({"value": [f"{r}," for r in rows]})
        yield pd.DataFrame({"value": ["]"] if held is None else [held, "]"]})

    df.select(raw).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_dataset(df: DataFrame, path: str, raw: str = "raw") -> None:
    """Write a table to a folder in the format of the suffix; JSON from ``raw`` where there is one; a folder for each text."""
    suffix, out = PurePosixPath(path).suffix.lower(), df.write.mode("overwrite")
    if suffix == ".json" and raw in df.columns:
        write_json_arrays(df, path, raw)
    elif suffix in (".jsonl", ".json"):
        df.select(raw).write.mode("overwrite").text(path) if raw in df.columns else out.json(path)
    elif suffix == ".csv":
        out.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif suffix == ".parquet":
        out.parquet(path)
    elif suffix in TEXT:
        name = F.element_at(F.split("path", "/"), -1) if "path" in df.columns else F.lit("text")
        df.select("text", name.alias("document")).write.mode("overwrite").partitionBy("document").text(path)
    else:
        raise ValueError(f"no writer for {suffix}")
