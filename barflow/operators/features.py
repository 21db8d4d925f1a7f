"""Feature panels: technical features, fractional differencing and higher time frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.functions import windows as W
from barflow.operators import ewm
from barflow.operators.asof import asof
from barflow.sources.bars import resample


def ffd_weights(d: float, least: float, most: int = 10_000) -> list[float]:
    """Weights of (1 - L) ** d, newest first, cut where they fall below ``least``."""
    out = [1.0]
    while len(out) < most:
        k = len(out)
        following = -out[-1] * (d - k + 1) / k
        if abs(following) < least:
            break
        out.append(following)
    return out


def fractional_difference(x: Column, d: float = 0.4, least: float = 1e-4) -> Column:
    """Fixed-width fractional difference; null until the window is full of values."""
    weights = ffd_weights(d, least)
    frame = W.series().rowsBetween(-(len(weights) - 1), 0)
    values = F.collect_list(x).over(frame)
    taps = F.array(*[F.lit(w) for w in reversed(weights)])
    dot = F.aggregate(F.zip_with(values, taps, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(values) == len(weights), dot)


def technical(bars: DataFrame, windows: tuple[int, ...] = (7, 14), vol_window: int = 50) -> DataFrame:
    """Bars with returns, volatilities, scores, ratios, RSI per window, MACD, ATR and realised volatility."""
    close = F.col("close")
    df = bars.withColumn("logret_1", W.log_return(close))
    for n in windows:
        df = df.withColumns({
            f"ret_{n}": W.momentum(close, n), f"mom_{n}": W.momentum(close, n), f"vol_{n}": W.rolling(F.stddev_samp, F.col("logret_1"), n),
            f"zscore_{n}": W.zscore(close, n), f"bb_pos_{n}": W.band_position(close, n), f"vol_ratio_{n}": W.ratio_to_mean(F.col("volume"), n),
        })
    df = ewm.indicators(df, rsi={f"rsi_{n}": n for n in windows}, atr={"atr_14": 14}, macd=True)
    return df.withColumns({"atr_norm": F.col("atr_14") / (close + W.EPS), "rv": W.rolling(F.stddev_samp, F.col("logret_1"), vol_window)})


def coarse_features(
    bars: DataFrame, hours: int, lookbacks: tuple[int, ...] = (1, 3), rsi_window: int = 14, vol_window: int = 14, indicators: bool = True
) -> DataFrame:
    """A compact feature set on resampled bars, with the sign of the return over three bars as trend.

    Without ``indicators`` the recursive ones (RSI, MACD, ATR) are left out.
    """
    p, close, df = f"tf{hours}h", F.col("close"), resample(bars, hours)
    own = {}
    if indicators:
        df = ewm.indicators(df, rsi={f"{p}_rsi_{rsi_window}": rsi_window}, atr={"_atr": 14}, macd=True)
        own = {f"{p}_macd_hist": F.col("macd_hist"), f"{p}_atr_norm": F.col("_atr") / (close + W.EPS)}
    df = df.withColumn("_lr", W.log_return(close))
    df = df.withColumns({f"{p}_{kind}_{n}": W.momentum(close, n) for n in lookbacks for kind in ("ret", "mom")} | own | {
        f"{p}_vol_{vol_window}": W.rolling(F.stddev_samp, F.col("_lr"), vol_window),
        f"{p}_zscore_{vol_window}": W.zscore(close, vol_window), f"{p}_trend": F.signum(W.momentum(close, 3)),
    })
    names = [c for c in df.columns if c.startswith(p)]
    return df.select("symbol", "ts", *[W.finite(F.col(c)).alias(c) for c in names])


def align_coarse(bars: DataFrame, coarse: DataFrame, hours: int) -> DataFrame:
    """Each hourly bar with the latest coarse bar that had closed when the hourly bar closed."""
    names = [c for c in coarse.columns if c not in ("symbol", "ts")]
    return asof(bars, coarse, F.col("ts") + F.expr("interval 1 hour"), F.col("ts") + F.expr(f"interval {hours} hours"), names).drop("available_at")


def confluence(df: DataFrame, side: Column, trends: list[str]) -> DataFrame:
    """Agreement of each trend with a side (0 where either is neutral), and their mean; missing trends are neutral."""
    agree = {t.replace("_trend", "_agree"): (F.coalesce(side, F.lit(0.0)) * F.coalesce(t, F.lit(0.0)) > 0).cast("double") for t in trends}
    mean = sum(agree.values(), F.lit(0.0)) / len(agree)
    return df.withColumns(agree | {"mtf_confluence": mean}).fillna(0.0, subset=trends)


#: Columns that carry levels, not features.
NOT_FEATURES = {"symbol", "ts", "open", "high", "low", "close", "volume", "funding_rate", "open_interest", "atr_14", "side"}


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a missing feature."""
    return df.dropna(how="any", subset=feature_columns(df))


def align_schema(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with every wanted column, absent ones as zero, and the names that were absent."""
    missing = [c for c in wanted if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}), missing
