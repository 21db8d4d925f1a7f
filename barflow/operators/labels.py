"""Signals, event sampling, first-touch labels and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import windows as W
from barflow.operators.chunks import chunked, expanding_median, folded

PRIOR = 0.005


def momentum_side(close: Column, lookback: int = 24) -> Column:
    """+1 where the return over ``lookback`` bars is not negative, else -1; null before there is one."""
    change = W.momentum(close, lookback)
    return F.when(change >= 0, 1.0).when(change < 0, -1.0)


def reversal_side(close: Column, lookback: int = 24) -> Column:
    """-1 where the close is at or above its mean, else +1; null before the mean is full."""
    mean = W.rolling(F.avg, close, lookback)
    return F.when(close >= mean, -1.0).when(close < mean, 1.0)


def barrier_target(df: DataFrame, kind: str = "atr") -> DataFrame:
    """``trgt``, the unit of the barriers: ATR over close, or realised volatility, carried forward only."""
    unit = F.col("atr_14") / F.nullif(F.col("close"), F.lit(0.0)) if kind == "atr" else F.col("rv")
    return df.withColumn("_unit", unit).withColumn("trgt", W.forward_fill(F.col("_unit"))).drop("_unit")


def cusum_threshold(bars: DataFrame, value: str = "trgt") -> DataFrame:
    """``bars`` with ``threshold``, the median of all barrier units so far."""
    return expanding_median(bars, value, "threshold", prior=PRIOR)


def _cusum_step(hits: bool):  # noqa: ANN202
    """One bar: both sums after it, and with ``hits`` the times at which one left its band."""

    def step(state: Column, bar: Column) -> Column:
        move = F.coalesce(bar["log"] - state["log"], F.lit(0.0))
        up, down = F.greatest(F.lit(0.0), state["up"] + move), F.least(F.lit(0.0), state["down"] + move)
        fell = down < -bar["limit"]
        rose = ~fell & (up > bar["limit"])
        after = [
            F.when(rose, 0.0).otherwise(up).alias("up"), F.when(fell, 0.0).otherwise(down).alias("down"), bar["log"].alias("log"),
        ]
        if hits:
            after.append(F.when(fell | rose, F.concat(state["hits"], F.array(bar["ts"]))).otherwise(state["hits"]).alias("hits"))
        return F.struct(*after)

    return step


def cusum_events(bars: DataFrame, threshold: Column) -> DataFrame:
    """(symbol, ts) where the cumulated log return leaves a symmetric band; only the side that fired starts anew.

    Resets make this a true sequence. A series is cut into stretches that are folded side by
    side; the sums of one that began elsewhere than its predecessor ended are folded again
    (``folded``). A sum forgets where it began as soon as it is reset or turns back to
    zero, so two or three rounds do for prices that go up and down.
    """
    limit = F.when(threshold > 0, threshold).otherwise(PRIOR)
    bar = F.struct("ts", F.ln("close").alias("log"), limit.alias("limit"))
    cut = chunked(bars.select("symbol", "ts", bar.alias("bar")))
    steps = cut.groupBy("symbol", "_chunk").agg(F.sort_array(F.collect_list("bar")).alias("_bars"))
    last = F.lag(F.element_at("_bars", -1)["log"]).over(Window.partitionBy("symbol").orderBy("_chunk"))
    steps = steps.withColumn("_log", last)
    none = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def begin(state: Column, *more: Column) -> Column:
        return F.struct(state["up"].alias("up"), state["down"].alias("down"), F.col("_log").alias("log"), *more)

    def fold(state: Column) -> Column:
        return F.aggregate("_bars", begin(state), _cusum_step(False), lambda s: F.struct(s["up"].alias("up"), s["down"].alias("down")))

    known = folded(steps, "_state", none, fold)
    none_yet = F.array().cast("array<timestamp_ntz>").alias("hits")
    hits = F.aggregate("_bars", begin(F.col("_state"), none_yet), _cusum_step(True), lambda s: s["hits"])
    return known.select("symbol", F.explode(hits).alias("ts"))


def event_times(bars: DataFrame, threshold: Column, min_events: int = 50, lookback: int = 24) -> DataFrame:
    """(symbol, ts, full_sampling): CUSUM events, or every bar after the lookback where a symbol has too few."""
    events = cusum_events(bars, threshold)
    counts = events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    place = bars.select("symbol", "ts", (F.row_number().over(W.series()) - 1).alias("place"))
    few = bars.select("symbol").distinct().join(counts, "symbol", "left").select("symbol", (F.coalesce("n", F.lit(0)) < min_events).alias("full_sampling"))
    every = place.filter(F.col("place") >= lookback).join(few.filter("full_sampling"), "symbol").select("symbol", "ts", "full_sampling")
    return events.join(few.filter("not full_sampling"), "symbol").select("symbol", "ts", "full_sampling").union(every)


def first_touch(bars: DataFrame, take: float = 1.5, stop: float = 1.5, bars_ahead: int = 24, min_target: float = 0.0) -> DataFrame:
    """Triple-barrier labels for every bar with ``side`` and ``trgt``.

    The scan starts at the bar after t0 and reads at most ``bars_ahead`` bars, carried in
    a bounded window array. Touching both barriers in one bar is a stop. Bars whose
    vertical barrier lies beyond the data are dropped.
    """
    w = W.series()
    ahead = F.collect_list(F.struct("high", "low", "close", "ts")).over(w.rowsBetween(1, bars_ahead))
    rows = bars.withColumns({"_path": ahead, "_end": F.lead("ts", bars_ahead).over(w)}).filter(
        F.col("trgt").isNotNull() & F.col("side").isNotNull() & F.col("_end").isNotNull() & (F.col("trgt") > min_target)
    )
    side, close, unit = F.col("side"), F.col("close"), F.greatest("trgt", F.lit(0.0)) * F.col("close")
    rows = rows.withColumns({"_tp": close + side * take * unit, "_sl": close - side * stop * unit})

    def touch(hit) -> Column:
        return F.array_min(F.filter(F.transform("_path", lambda b, i: F.when(hit(b), i + 1)), lambda i: i.isNotNull()))

    rows = rows.withColumns({
        "_t": touch(lambda b: F.when(side > 0, b["high"] >= F.col("_tp")).otherwise(b["low"] <= F.col("_tp"))),
        "_s": touch(lambda b: F.when(side > 0, b["low"] <= F.col("_sl")).otherwise(b["high"] >= F.col("_sl"))),
    })
    stopped = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s") <= F.col("_t")))
    taken = F.col("_t").isNotNull() & ~stopped
    held = F.when(stopped, F.col("_s")).when(taken, F.col("_t")).otherwise(bars_ahead)
    last = F.col("_path")[bars_ahead - 1]["close"]
    simple = F.least(F.greatest(side * (last / F.greatest(close, F.lit(W.EPS)) - 1), F.lit(-1 + 1e-12)), F.lit(1e6))
    ret = (
        F.when(stopped, F.log1p(-F.least(F.greatest(stop * F.col("trgt"), F.lit(0.0)), F.lit(1 - 1e-6))))
        .when(taken, F.log1p(F.greatest(take * F.col("trgt"), F.lit(0.0))))
        .otherwise(F.log1p(simple))
    )
    rows = rows.withColumns({"_held": held, "ret": ret})
    label = F.when(stopped, 0).when(taken, 1).otherwise((F.col("ret") > 0).cast("int"))
    return rows.select(
        "symbol", F.col("ts").alias("t0"), F.get("_path", F.col("_held") - 1)["ts"].alias("t1"), "side", "trgt", "close", "ret",
        label.alias("bin"), F.col("_held").cast("int").alias("bars_held"),
    )


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, ts, rn, concurrent): open events per bar over closed intervals, by running sums of starts and ends.

    Bars, starts and ends are stacked and summed per time, so there is no join. Ends of
    events must be times of bars.
    """
    one, none = F.lit(1), F.lit(0)
    stacked = bars.select("symbol", "ts", one.alias("bar"), none.alias("s"), none.alias("e")).union(
        events.select("symbol", F.explode(F.array(
            F.struct(F.col("t0").alias("ts"), none.alias("bar"), one.alias("s"), none.alias("e")),
            F.struct(F.col("t1").alias("ts"), none.alias("bar"), none.alias("s"), one.alias("e")),
        )).alias("x")).select("symbol", "x.*")
    )
    times = stacked.groupBy("symbol", "ts").agg(F.max("bar").alias("bar"), F.sum("s").alias("s"), F.sum("e").alias("e")).filter("bar = 1")
    w = W.series()
    opened = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return times.select("symbol", "ts", F.row_number().over(w).alias("rn"), (opened - closed).alias("concurrent"))


def uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Events with ``uniq``, the mean of 1 / concurrency over their bars, by prefix sums at both ends."""
    inverse = F.when(F.col("concurrent") > 0, 1.0 / F.col("concurrent")).otherwise(0.0)
    sums = concurrency(bars, events).withColumn("inv", inverse).withColumn(
        "acc", F.sum("inv").over(W.series().rowsBetween(Window.unboundedPreceding, 0))
    )
    at0 = sums.select("symbol", F.col("ts").alias("t0"), F.col("rn").alias("r0"), (F.col("acc") - F.col("inv")).alias("a0"))
    at1 = sums.select("symbol", F.col("ts").alias("t1"), F.col("rn").alias("r1"), F.col("acc").alias("a1"))
    joined = events.join(at0, ["symbol", "t0"]).join(at1, ["symbol", "t1"])
    return joined.withColumn("uniq", (F.col("a1") - F.col("a0")) / (F.col("r1") - F.col("r0") + 1)).select(*events.columns, "uniq")


def return_weights(events: DataFrame) -> DataFrame:
    """Events with ``w``: absolute return times uniqueness, of mean one per symbol."""
    raw = F.coalesce(F.abs("ret") * F.coalesce("uniq", F.lit(1e-6)), F.lit(0.0))
    return events.withColumn("_raw", raw).withColumn("w", F.col("_raw") / (F.avg("_raw").over(Window.partitionBy("symbol")) + W.EPS)).drop("_raw")


def time_decay(events: DataFrame, oldest: float = 0.5) -> DataFrame:
    """Events with ``w_decay``, linear in the rank of t0 from ``oldest`` to one."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("t0")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return events.withColumn("w_decay", oldest + (1 - oldest) * rank / F.greatest(n - 1, F.lit(1)))


def combined_weights(events: DataFrame) -> DataFrame:
    """Events with ``w``: return weight times time decay, of mean one per symbol; ``uniq`` must be there."""
    df = time_decay(return_weights(events)).withColumn("_raw", F.col("w") * F.col("w_decay"))
    return df.withColumn("w", F.col("_raw") / (F.avg("_raw").over(Window.partitionBy("symbol")) + W.EPS)).drop("_raw", "w_decay")
