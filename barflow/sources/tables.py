"""Ticks and bars as tables partitioned by day: new ticks read and rewrite the days they touch, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.sources import bars as source
from barflow.stored import discard, stored


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("ts"))


def days_of(rows: DataFrame) -> list:
    """The days that rows touch; as many as an arrival spans."""
    return sorted(r[0] for r in by_day(rows).select("day").distinct().collect() if r[0] is not None)


def read_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The rows of some days; the filter picks folders, so other days are not read."""
    return spark.read.parquet(path).filter(F.col("day").isin(days))


def replace_days(rows: DataFrame, path: str) -> None:
    """Write rows with ``day`` over the days they have; other days stay. Written again, they give the same table."""
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge(incoming: DataFrame, path: str, keys: list[str]) -> list:
    """Merge rows into a table by day; the incoming row wins where both have a key. Returns the days touched.

    The merged days are put aside before they are written over, since they are read from the same table.
    """
    spark = incoming.sparkSession
    incoming = by_day(source.keep_first(incoming, keys, keys))
    days = days_of(incoming)
    if not days:
        return days
    merged = source.upsert(read_days(spark, path, days), incoming, keys) if exists(spark, path) else incoming
    aside = stored(merged)
    replace_days(aside, path)
    discard(aside)
    return days


def merge_ticks(incoming: DataFrame, ticks_path: str, bars_path: str) -> list:
    """Merge ticks, late ones too, and make the bars of the days they touch anew. Returns these days.

    A bar lies within a day, so the bars equal those of a full rebuild. The same ticks merged
    again change nothing.
    """
    spark = incoming.sparkSession
    days = merge(incoming.select("symbol", "ts", "tick_id", "price"), ticks_path, ["symbol", "ts", "tick_id"])
    if days:
        replace_days(by_day(source.bars_from_ticks(read_days(spark, ticks_path, days))), bars_path)
    return days
