"""Positions: consecutive numbers for rows in a given order, without sorting everything in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[str] = []


#: Rows of a bucket, within which running sums are taken in one task.
BUCKET = 65536


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder in spark.checkpoint.dir; the folder's owner clears it.

    Where that is unset, a local session gets a temporary folder, which goes when Python ends; a cluster is refused, as
    its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + (made := tempfile.mkdtemp(prefix="sluicework-")))
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written to a path of ``scratch`` and read again."""
    path = scratch(df.sparkSession, "positions")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with 0-based positions.

    Rows are range-partitioned by ``order`` and numbered within partitions; that is written once, as a second
    evaluation might draw other ranges. Positions then shift by the row counts of the partitions ahead, a table with
    one small row for each partition, which is broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("__m", F.monotonically_increasing_id())
    rows = written(rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__k", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m"))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__p", ahead.alias("__a"))
    return rows.join(F.broadcast(shifts), "__p").withColumn(name, F.col("__a") + F.col("__k")).drop("__p", "__k", "__a")


def running(df: DataFrame, *order: Column | str, value: Column, name: str = "running") -> DataFrame:
    """``df`` with the sum of the long ``value`` (null: 0) over all rows up to this one in the given order.

    Sums are taken within buckets of BUCKET positions, then over the buckets' totals, so that one task sees a row for
    each bucket only.
    """
    rows = numbered(df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0))), *order, name="__at").withColumn("__b", F.floor(F.col("__at") / BUCKET))
    totals = rows.groupBy("__b").agg(F.sum("__v").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("__v").over(Window.partitionBy("__b").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__s", inside).join(totals.select("__b", ahead.alias("__a")), "__b")
    return rows.withColumn(name, F.col("__a") + F.col("__s")).drop("__v", "__at", "__b", "__s", "__a")
