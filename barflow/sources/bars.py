"""Bars from ticks, coarser bars, upserts and the rule for unfinished bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, ts, tick_id, price): the event stream as ticks; prices that are not positive are no prices."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price")).filter("price > 0")


def bars_from_ticks(rows: DataFrame, unit: str = "hour") -> DataFrame:
    """Open-stamped OHLCV bars; empty bars do not appear."""
    place = F.struct("ts", "tick_id")
    return rows.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", place).alias("close"), F.sum("price").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, folder))


def resample(bars: DataFrame, hours: int) -> DataFrame:
    """Coarser bars, left-closed and left-labelled."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (3600 * hours)) * (3600 * hours)).cast("timestamp_ntz")
    return bars.groupBy("symbol", start.alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def drop_incomplete(bars: DataFrame, now: DataFrame, hours: int = 1) -> DataFrame:
    """Bars that have ended by ``now``, a table of one row with column now."""
    return bars.join(F.broadcast(now), F.col("ts") + F.expr(f"interval {hours} hours") <= F.col("now")).drop("now")


def upsert(known: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the incoming one where both have a key."""
    stacked = known.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return stacked.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place", "_new")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
