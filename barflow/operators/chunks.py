"""Series cut into stretches of time, so that one long series is many tasks."""

from __future__ import annotations

from bisect import insort
from math import ceil, isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.stored import discard, stored

#: Rows of a stretch where they are spread evenly over time, and stretches of a series at most.
ROWS, MOST = 512, 1024


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def chunked(df: DataFrame, rows: int = ROWS, most: int = MOST, by: str = "symbol", order: str = "ts") -> DataFrame:
    """``df`` with ``_chunk``: stretches of one length in time within each series, numbered from 0.

    Where rows are spread evenly, a stretch has about ``rows`` of them, or more in series of over
    ``rows * most``. Only the series' bounds are computed for it, a row per series.
    """
    at = micros(F.col(order))
    spans = df.groupBy(by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("_n"))
    parts = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows)))
    place = F.floor((at - F.col("_a")) / ((F.col("_b") - F.col("_a") + 1) / parts)).cast("int")
    return df.join(spans, by).withColumn("_chunk", F.least(place, parts.cast("int") - 1)).drop("_a", "_b", "_n")


def _medians(rows: pa.Table, near: pa.Table, value: str, order: str, out: str, min_periods: int, prior: float) -> pa.Table:
    """The rows of one stretch, in order, with the median of all values so far.

    ``near`` has the earlier values about their middle, how many others lie ``below`` them, and
    how many there are in all; the middle moves by one place at most with each value.
    """
    rows = rows.sort_by(order)
    values = sorted(x for x in near["x"].to_pylist() if x is not None)
    below, n = (near[c][0].as_py() for c in ("below", "n")) if len(near) else (0, 0)
    made = []
    for x in rows[value].to_pylist():
        if x is not None:
            insort(values, x)
            n += 1
        if n < min_periods:
            made.append(prior)
        else:
            low, high = values[(n - 1) // 2 - below], values[n // 2 - below]
            made.append(low + (high - low) * 0.5)
    return rows.append_column(out, pa.array(made, pa.float64()))


def expanding_median(df: DataFrame, value: str, out: str, min_periods: int = 50, prior: float = 0.005, by: str = "symbol", order: str = "ts") -> DataFrame:
    """``df`` with the median of all values of the series so far; the prior until there are ``min_periods``.

    Values are put in order once, by ranges, and dealt into buckets of equal size. Counts
    per stretch of time and bucket say between which earlier values a stretch's medians lie; it
    reads just these besides its own rows. With stretches and buckets of about the square root
    of the longest series, all that is in proportion to its rows but for the sort, and no
    task has a series as a whole. Null values are passed over.
    """
    longest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0  # one number
    size = max(256, isqrt(longest))
    cut = stored(chunked(df, size, max(1, ceil(longest / size)), by, order))
    known = cut.filter(F.col(value).isNotNull()).select(F.col(by).alias("s"), F.col("_chunk").alias("c"), F.col(value).alias("x"))
    ranked = known.repartitionByRange("s", "x").sortWithinPartitions("s", "x").withColumn("_id", F.monotonically_increasing_id())
    # The id counts rows within a partition, and partitions are in order.
    bucket = F.shiftright("_id", 33) * (1 << 33) + F.floor((F.col("_id") % (1 << 33)) / size)
    ranked = stored(ranked.select("s", "c", "x", bucket.alias("b")))
    counts = ranked.groupBy("s", "c", "b").agg(F.count(F.lit(1)).alias("k"))
    # Stretches by buckets, about as many as rows.
    stretches = cut.select(F.col(by).alias("s"), F.col("_chunk").alias("c")).distinct()
    cells = stretches.join(counts.select("s", "b").distinct(), "s").join(counts, ["s", "c", "b"], "left")
    before = Window.partitionBy("s", "b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("had", F.coalesce(F.sum("k").over(before), F.lit(0)))
    row = Window.partitionBy("s", "c")
    cells = cells.select(
        "s", "c", "b", "had", F.coalesce(F.sum("had").over(row.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("under"),
        F.sum("had").over(row).alias("n"), F.coalesce(F.sum("k").over(row), F.lit(0)).alias("m"),
    )
    low, high = F.floor((F.col("n") - F.col("m") - 1) / 2), F.ceil((F.col("n") + F.col("m") - 1) / 2)
    needed = cells.filter((F.col("had") > 0) & (F.col("under") <= high) & (F.col("under") + F.col("had") > low))
    needed = needed.select("s", "b", F.col("c").alias("of"), "n", F.min("under").over(row).alias("below"))
    near = needed.join(ranked, ["s", "b"]).filter("c < of").select("s", F.col("of").alias("_of"), "x", "n", "below")
    schema = cut.withColumn(out, F.lit(0.0)).schema

    def medians(rows: pa.Table, some: pa.Table) -> pa.Table:
        return _medians(rows, some, value, order, out, max(min_periods, 5), prior).select(schema.names)

    return cut.groupBy(by, "_chunk").cogroup(near.groupBy("s", "_of")).applyInArrow(medians, schema).drop("_chunk")


def folded(steps: DataFrame, state: str, start: Column, fold, by: str = "symbol") -> DataFrame:  # noqa: ANN001
    """``steps``, one row per stretch (by, _chunk, and what ``fold`` reads), with ``state``: the state each begins with.

    ``fold(column)`` gives the state after a stretch from that before it. All stretches are folded at once
    from ``start``; those whose predecessor ended elsewhere are folded again, until all agree. A
    round is one job over all stretches. States that forget their start within a stretch, as those
    that are reset do, take two or three rounds; otherwise there are no more rounds than stretches in a series.
    """
    order = Window.partitionBy(by).orderBy("_chunk")
    now = stored(steps.withColumn(state, start).withColumn("_end", fold(F.col(state))))
    while True:
        began = F.coalesce(F.lag("_end").over(order), start)
        checked = now.withColumns({"_began": began})
        if checked.filter(F.col("_began") != F.col(state)).isEmpty():
            return now.drop("_end")
        again = F.when(F.col("_began") != F.col(state), fold(F.col("_began"))).otherwise(F.col("_end"))
        later = stored(checked.withColumn("_end", again).withColumn(state, F.col("_began")).drop("_began"))
        discard(now)
        now = later


def numbered(df: DataFrame, out: str = "rn", rows: int = ROWS, by: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``df`` with the place of each row in its series, from 0, found stretch by stretch.

    Rows are numbered within stretches of time; what lies before a stretch is a running sum over one row per stretch.
    """
    cut = stored(chunked(df, rows, MOST, by, order[0]))
    counts = cut.groupBy(by, "_chunk").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(*order)) - 1
    return cut.join(counts, [by, "_chunk"]).withColumn(out, F.col("_before") + own).drop("_chunk", "_before")


def with_frames(df: DataFrame, n: int, columns, rows: int = ROWS, by: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:  # noqa: ANN001
    """``df`` with window columns that look back over at most ``n`` rows, a series being many tasks.

    ``columns(window)`` gives {name: Column} over an ordered window without frame. Rows are dealt
    into blocks by their place; the last ``n - 1`` rows of a block, its halo, are in the next one too and
    are dropped there once the frames have been read.
    """
    size = max(rows, n)
    placed = numbered(df, "_rn", rows, by, order).withColumn("_block", F.floor(F.col("_rn") / size))
    tail = placed.filter(F.col("_rn") % size > size - n).withColumns({"_block": F.col("_block") + 1, "_halo": F.lit(True)})
    both = placed.withColumn("_halo", F.lit(False)).unionByName(tail)
    window = Window.partitionBy(by, "_block").orderBy("_rn")
    return both.withColumns(columns(window)).filter("not _halo").drop("_rn", "_block", "_halo")
