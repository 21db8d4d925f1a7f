"""Purged and embargoed folds, combinatorial folds, and what must hold for them."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_groups(events: DataFrame, n: int) -> DataFrame:
    """Events with ``grp`` 0 .. n-1, contiguous in t0, and ``place``, their rank; earlier groups get the extra rows."""
    w = Window.partitionBy("symbol").orderBy("t0", "t1")
    return events.withColumns({"grp": F.ntile(n).over(w) - 1, "place": F.row_number().over(w) - 1})


def group_bounds(grouped: DataFrame, embargo: float) -> DataFrame:
    """Per symbol and group: start, latest label end, and the embargo's number of rows. A row per group, whatever the data."""
    size = Window.partitionBy("symbol")
    bounds = grouped.groupBy("symbol", "grp").agg(F.min("t0").alias("start"), F.max("t1").alias("stop"), F.count(F.lit(1)).alias("n"))
    return bounds.withColumn("embargo", F.floor(F.sum("n").over(size) * F.lit(embargo))).select("symbol", "grp", "start", "stop", "embargo")


def after_rank(grouped: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds with ``first_after``, the rank of the first event that starts after the group's latest label end.

    Found by stacking bounds and events in time order, not by a range join.
    """
    events = grouped.select("symbol", F.col("t0").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("grp"))
    stops = bounds.select("symbol", F.col("stop").alias("at"), F.lit(0).alias("one"), "grp")
    w = Window.partitionBy("symbol").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = events.union(stops).withColumn("first_after", F.sum("one").over(w)).filter("grp is not null")
    return bounds.join(counted.select("symbol", "grp", "first_after"), ["symbol", "grp"])


def purged_folds(events: DataFrame, n: int = 5, embargo: float = 0.01) -> DataFrame:
    """(symbol, fold, t0, t1, part): every event of each fold as test, train, purged or embargoed.

    An event is purged where its label interval meets the test group's; the embargo takes
    the first rows that start after the group's latest label end.
    """
    grouped = assign_groups(events.select("symbol", "t0", "t1"), n)
    bounds = after_rank(grouped, group_bounds(grouped, embargo)).withColumnRenamed("grp", "fold")
    rows = grouped.join(F.broadcast(bounds), "symbol")  # n rows per symbol
    overlap = (F.col("t1") >= F.col("start")) & (F.col("t0") <= F.col("stop"))
    late = (F.col("place") >= F.col("first_after")) & (F.col("place") < F.col("first_after") + F.col("embargo"))
    part = F.when(F.col("grp") == F.col("fold"), "test").when(overlap, "purged").when(late, "embargoed").otherwise("train")
    return rows.select("symbol", "fold", "t0", "t1", part.alias("part"))


def combinations(n: int, k: int) -> list[tuple[int, ...]]:
    from itertools import combinations as choose

    return list(choose(range(n), k))


def paths(n: int, k: int) -> int:
    """Back-test paths that the combinations make."""
    return comb(n, k) * k // n


def combinatorial_folds(events: DataFrame, n: int = 6, k: int = 2, embargo: float = 0.01) -> DataFrame:
    """(symbol, combo, t0, part) with ``part`` test, train or out: purged or embargoed for a test group of the combination."""
    spark = events.sparkSession
    grouped = assign_groups(events.select("symbol", "t0", "t1"), n)
    bounds = after_rank(grouped, group_bounds(grouped, embargo)).withColumnRenamed("grp", "test_grp")
    rows = [(c, g) for c, groups in enumerate(combinations(n, k)) for g in groups]
    combos = spark.createDataFrame(rows, "combo int, test_grp int")
    per_group = grouped.join(F.broadcast(bounds), "symbol")
    overlap = (F.col("t1") >= F.col("start")) & (F.col("t0") <= F.col("stop"))
    late = (F.col("place") >= F.col("first_after")) & (F.col("place") < F.col("first_after") + F.col("embargo"))
    judged = per_group.select("symbol", "t0", "test_grp", (F.col("grp") == F.col("test_grp")).alias("test"), (overlap | late).alias("out"))
    return judged.join(F.broadcast(combos), "test_grp").groupBy("symbol", "combo", "t0").agg(
        F.when(F.max("test"), "test").when(F.max("out"), "out").otherwise("train").alias("part")
    )


def embargo_times(events: DataFrame, share: float) -> DataFrame:
    """(symbol, t0, embargo_until): the time ``share`` of the rows ahead, or the last one."""
    w = Window.partitionBy("symbol").orderBy("t0")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    step = F.floor(n * F.lit(share))
    placed = events.select("symbol", "t0", F.row_number().over(w).alias("p"), step.cast("int").alias("s"), F.max("t0").over(Window.partitionBy("symbol")).alias("last"))
    ahead = placed.select("symbol", F.col("p").alias("q"), F.col("t0").alias("then"))
    joined = placed.join(ahead.withColumnRenamed("symbol", "sym"), (F.col("symbol") == F.col("sym")) & (F.col("q") == F.col("p") + F.col("s")), "left")
    return joined.select("symbol", "t0", F.coalesce("then", "last").alias("embargo_until"))


def overlaps(folds: DataFrame) -> DataFrame:
    """Per symbol and fold, train rows whose label meets the test labels' hull (must be none), and all such rows that are no test."""
    hull = folds.filter("part = 'test'").groupBy("symbol", "fold").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    meets = (F.col("t1") >= F.col("a")) & (F.col("t0") <= F.col("b"))
    n = lambda c: F.sum((c & meets).cast("long"))
    return folds.join(F.broadcast(hull), ["symbol", "fold"]).groupBy("symbol", "fold").agg(
        n(F.col("part") == "train").alias("n_overlaps"), n(F.col("part") != "test").alias("n_before_purge")
    )


def embargo_violations(events: DataFrame, folds: DataFrame, n: int, embargo: float) -> DataFrame:
    """(symbol, fold, t0) of train rows among the first rows after a test group's latest label end, as many as the embargo takes.

    Found anew from the events: what follows a group is numbered there and must be absent from its train rows.
    """
    grouped = assign_groups(events.select("symbol", "t0", "t1"), n)
    stops = group_bounds(grouped, embargo).select("symbol", F.col("grp").alias("fold"), "stop", "embargo")
    after = grouped.join(stops, "symbol").filter(F.col("t0") > F.col("stop"))  # n rows per symbol
    k = F.row_number().over(Window.partitionBy("symbol", "fold").orderBy("t0", "t1"))
    banned = after.withColumn("k", k).filter(F.col("k") <= F.col("embargo")).select("symbol", "fold", "t0")
    return banned.join(folds.filter("part = 'train'").select("symbol", "fold", "t0"), ["symbol", "fold", "t0"], "left_semi")


def combination_overlaps(events: DataFrame, n: int, k: int, embargo: float) -> DataFrame:
    """(symbol, combo, n_overlaps): train rows of each combination whose label meets the hull of one of its test groups."""
    parts = combinatorial_folds(events, n, k, embargo)
    grouped = assign_groups(events.select("symbol", "t0", "t1"), n)
    rows = parts.join(grouped.select("symbol", "t0", "t1", "grp"), ["symbol", "t0"])
    hulls = rows.filter("part = 'test'").groupBy("symbol", "combo", "grp").agg(F.min("t0").alias("a"), F.max("t1").alias("b")).drop("grp")
    met = rows.filter("part = 'train'").join(hulls, ["symbol", "combo"])  # k rows per combination
    return met.groupBy("symbol", "combo").agg(F.sum(((F.col("t1") >= F.col("a")) & (F.col("t0") <= F.col("b"))).cast("long")).alias("n_overlaps"))
