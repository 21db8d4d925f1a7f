"""As-of joins: each left row takes the latest right row that is available by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.chunks import MOST, ROWS, chunked
from barflow.stored import stored


def asof(
    left: DataFrame, right: DataFrame, at: Column, available: Column, take: list[str], by: str = "symbol", prefix: str = ""
) -> DataFrame:
    """``left`` with the ``take`` columns of the latest right row whose ``available`` time is at or before ``at``.

    Both sides are stacked in order of time, right rows first on ties, and the last right
    row is carried forward: one shuffle by key, no range join. Unmatched rows get null.
    """
    carried = F.struct(*[F.col(c).alias(c) for c in take], available.alias("_available"))
    kind = right.select(carried.alias("c")).schema["c"].dataType
    a = left.select(F.col(by).alias("_by"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_take"))
    b = right.select(F.col(by), available, F.lit(0), F.lit(None).cast(a.schema["_row"].dataType), carried)
    latest = Window.partitionBy("_by").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b.filter(available.isNotNull())).withColumn("_latest", F.last("_take", ignorenulls=True).over(latest))
    return both.filter("_side = 1").select(
        "_row.*", *[F.col(f"_latest.{c}").alias(prefix + c) for c in take], F.col("_latest._available").alias(f"{prefix}available_at")
    )


def asof_stretches(
    left: DataFrame, right: DataFrame, at: Column, available: Column, take: list[str], by: str = "symbol", prefix: str = "", rows: int = ROWS
) -> DataFrame:
    """As ``asof``, with each series cut into stretches of time, so that a hot one is many tasks.

    Within a stretch the last right row is carried forward; the last of all earlier stretches comes from one row
    per stretch and serves where the stretch itself has none yet.
    """
    carried = F.struct(*[F.col(c).alias(c) for c in take], available.alias("_available"))
    kind = right.select(carried.alias("c")).schema["c"].dataType
    a = left.select(F.col(by).alias("_by"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_take"))
    b = right.select(F.col(by), available, F.lit(0), F.lit(None).cast(a.schema["_row"].dataType), carried)
    both = stored(chunked(a.union(b.filter(available.isNotNull())).filter("_by is not null and _at is not null"), rows, MOST, "_by", "_at"))
    ends = both.filter("_side = 0").groupBy("_by", "_chunk").agg(F.max_by("_take", "_at").alias("_end"))
    every = both.select("_by", "_chunk").distinct().join(ends, ["_by", "_chunk"], "left")
    earlier = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("_by", "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    own = Window.partitionBy("_by", "_chunk").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.coalesce(F.last("_take", ignorenulls=True).over(own), "_before")
    found = both.join(before, ["_by", "_chunk"]).withColumn("_latest", latest).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_latest.{c}").alias(prefix + c) for c in take], F.col("_latest._available").alias(f"{prefix}available_at"))
