"""Queries over bars and feature panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from barflow.functions import windows as W
from barflow.functions.windows import rounded
from barflow.operators import chunks, ewm, features
from barflow.operators.asof import asof_stretches
from barflow.plans import sql
from barflow.plans.registry import query
from barflow.sources import bars as source

OHLCV = "symbol, ts, round(open, 6) + 0 AS open, round(high, 6) + 0 AS high, round(low, 6) + 0 AS low, round(close, 6) + 0 AS close, round(volume, 6) + 0 AS volume"


def shown(df: DataFrame, *names: str, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(c)).alias(c) for c in names])


def ohlcv(df: DataFrame) -> DataFrame:
    return shown(df, "open", "high", "low", "close", "volume")


@query(f"WITH {sql.BARS} SELECT {OHLCV} FROM bars")
def bars_1h(spark: SparkSession, folder: str) -> DataFrame:
    return ohlcv(source.hourly(spark, folder))


@query(f"WITH {sql.BARS}, {sql.coarse(4, 'c')} SELECT {OHLCV.replace('ts,', 'bar AS ts,', 1)} FROM c")
def bars_resample_4h(spark: SparkSession, folder: str) -> DataFrame:
    return ohlcv(source.resample(source.hourly(spark, folder), 4))


@query(f"WITH {sql.BARS}, {sql.coarse(24, 'c')} SELECT {OHLCV.replace('ts,', 'bar AS ts,', 1)} FROM c")
def bars_resample_1d(spark: SparkSession, folder: str) -> DataFrame:
    return ohlcv(source.resample(source.hourly(spark, folder), 24))


@query("""WITH o AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderdate, o_orderkey, o_totalprice AS p FROM orders)
SELECT symbol, ts, round(arg_min(p, (o_orderdate, o_orderkey)), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low,
  round(arg_max(p, (o_orderdate, o_orderkey)), 6) AS close, round(sum(p), 2) AS volume FROM o GROUP BY ALL""")
def order_bars_1d(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("tick_id"), F.col("o_totalprice").alias("price")
    )
    return shown(source.bars_from_ticks(rows, "day").withColumn("volume", F.round("volume", 2)), "open", "high", "low", "close", "volume")


@query(f"""WITH {sql.BARS}, late AS (SELECT * REPLACE (close + 1 AS close) FROM bars WHERE ts >= TIMESTAMP '2024-01-20')
SELECT {OHLCV} FROM (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-25' AND ts NOT IN (SELECT ts FROM late WHERE late.symbol = bars.symbol) UNION ALL SELECT * FROM late)""")
def upsert_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    bars = source.hourly(spark, folder)
    known, late = bars.filter("ts < timestamp_ntz '2024-01-25'"), bars.filter("ts >= timestamp_ntz '2024-01-20'").withColumn("close", F.col("close") + 1)
    return ohlcv(source.upsert(known, late, ["symbol", "ts"]))


@query(f"WITH {sql.BARS} SELECT {OHLCV} FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks)")
def drop_incomplete_bar(spark: SparkSession, folder: str) -> DataFrame:
    now = source.ticks(spark, folder).agg(F.max("ts").alias("now"))
    return ohlcv(source.drop_incomplete(source.hourly(spark, folder), now))


@query(f"WITH {sql.BARS} SELECT symbol, ts, round(ln(close) - ln(lag(close) OVER w), 6) + 0 AS logret_1 FROM bars {sql.W}")
def log_returns(spark: SparkSession, folder: str) -> DataFrame:
    return shown(source.hourly(spark, folder).withColumn("logret_1", W.log_return(F.col("close"))), "logret_1")


@query(f"""WITH {sql.BARS} SELECT symbol, ts, round(close / lag(close, 7) OVER w - 1, 6) + 0 AS mom_7,
round(close / lag(close, 14) OVER w - 1, 6) + 0 AS mom_14, round(close / lag(close, 28) OVER w - 1, 6) + 0 AS mom_28 FROM bars {sql.W}""")
def momentum(spark: SparkSession, folder: str) -> DataFrame:
    df = source.hourly(spark, folder).withColumns({f"mom_{n}": W.momentum(F.col("close"), n) for n in (7, 14, 28)})
    return shown(df, "mom_7", "mom_14", "mom_28")


_M, _S = sql.rolling("avg", "close", 14), sql.rolling("stddev_samp", "close", 14)


@query(f"""WITH {sql.BARS} SELECT symbol, ts, round((close - {_M}) / ({_S} + 1e-12), 6) + 0 AS zscore_14,
round((close - {_M}) / (2 * {_S} + 1e-12), 6) + 0 AS bb_pos_14 FROM bars""")
def rolling_zscore(spark: SparkSession, folder: str) -> DataFrame:
    close = F.col("close")
    df = source.hourly(spark, folder).withColumns({"zscore_14": W.zscore(close, 14), "bb_pos_14": W.band_position(close, 14)})
    return shown(df, "zscore_14", "bb_pos_14")


@query(f"""WITH {sql.BARS}, l AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS lr FROM bars {sql.W})
SELECT symbol, ts, round({sql.rolling('stddev_samp', 'lr', 50)}, 6) + 0 AS rv FROM l""")
def realized_vol(spark: SparkSession, folder: str) -> DataFrame:
    df = source.hourly(spark, folder).withColumn("lr", W.log_return(F.col("close")))
    return shown(df.withColumn("rv", W.rolling(F.stddev_samp, F.col("lr"), 50)), "rv")


@query(f"WITH {sql.BARS} SELECT symbol, ts, round(volume / ({sql.rolling('avg', 'volume', 14)} + 1e-12), 6) + 0 AS vol_ratio_14 FROM bars")
def volume_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return shown(source.hourly(spark, folder).withColumn("vol_ratio_14", W.ratio_to_mean(F.col("volume"), 14)), "vol_ratio_14")


_MACD = f"""e AS (SELECT *, {sql.mean('close', 2 / 13)} - {sql.mean('close', 2 / 27)} AS m FROM bars), s AS (SELECT *, {sql.mean('m', 2 / 10)} AS sig FROM e)"""


@query(f"""WITH {sql.BARS}, {_MACD} SELECT symbol, ts, round(m / (close + 1e-12), 6) + 0 AS macd, round(sig / (close + 1e-12), 6) + 0 AS macd_signal,
round((m - sig) / (close + 1e-12), 6) + 0 AS macd_hist FROM s""")
def ema_macd(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ewm.macd(source.hourly(spark, folder)), "macd", "macd_signal", "macd_hist")


@query(f"""WITH {sql.BARS}, d AS (SELECT *, close - lag(close) OVER w AS d FROM bars {sql.W}),
u AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM d),
m AS (SELECT *, {sql.mean('up', 1 / 14)} AS mu, {sql.mean('down', 1 / 14)} AS md FROM u)
SELECT symbol, ts, round(100 - 100 / (1 + mu / (md + 1e-12)), 5) + 0 AS rsi_14 FROM m""")
def rsi_14(spark: SparkSession, folder: str) -> DataFrame:
    df = ewm.rsi(source.hourly(spark, folder), 14, "rsi_14")
    return df.select("symbol", "ts", rounded(F.col("rsi_14"), 5).alias("rsi_14"))


@query(f"WITH {sql.BARS}, {sql.ATR} SELECT symbol, ts, round(atr_14, 6) + 0 AS atr_14, round(atr_14 / (close + 1e-12), 6) + 0 AS atr_norm FROM atr")
def atr_14(spark: SparkSession, folder: str) -> DataFrame:
    df = ewm.atr(source.hourly(spark, folder), 14, "atr_14")
    return shown(df.withColumn("atr_norm", F.col("atr_14") / (F.col("close") + W.EPS)), "atr_14", "atr_norm")


_TAPS = features.ffd_weights(0.4, 1e-2)
_DOT = " + ".join(f"({w!r}::DOUBLE) * lag(ln(close), {k}) OVER w" for k, w in enumerate(_TAPS))


@query(f"WITH {sql.BARS} SELECT symbol, ts, round({_DOT}, 6) + 0 AS close_fd FROM bars {sql.W}")
def fracdiff(spark: SparkSession, folder: str) -> DataFrame:
    return shown(source.hourly(spark, folder).withColumn("close_fd", features.fractional_difference(F.ln("close"), 0.4, 1e-2)), "close_fd")


_COARSE = f"""{sql.coarse(4, 'c4')}, f4 AS (SELECT symbol, bar, close / lag(close) OVER c - 1 AS tf4h_ret_1, close / lag(close, 3) OVER c - 1 AS tf4h_ret_3,
  sign(close / lag(close, 3) OVER c - 1)::DOUBLE AS tf4h_trend FROM c4 WINDOW c AS (PARTITION BY symbol ORDER BY bar)),
{sql.coarse(24, 'c24')}, f24 AS (SELECT symbol, bar, sign(close / lag(close, 3) OVER c - 1)::DOUBLE AS tf24h_trend FROM c24 WINDOW c AS (PARTITION BY symbol ORDER BY bar))"""


@query(f"""WITH {sql.BARS}, {_COARSE} SELECT b.symbol, b.ts, round(f.tf4h_ret_1, 6) + 0 AS tf4h_ret_1, round(f.tf4h_ret_3, 6) + 0 AS tf4h_ret_3, f.tf4h_trend + 0 AS tf4h_trend
FROM bars b ASOF LEFT JOIN f4 f ON f.symbol = b.symbol AND b.ts + INTERVAL 1 HOUR >= f.bar + INTERVAL 4 HOUR""")
def mtf_asof_join(spark: SparkSession, folder: str) -> DataFrame:
    bars = source.hourly(spark, folder)
    return shown(features.align_coarse(bars, features.coarse_features(bars, 4, indicators=False), 4), "tf4h_ret_1", "tf4h_ret_3", "tf4h_trend")


_BY_BAR = "WINDOW c AS (PARTITION BY symbol ORDER BY bar)"
_COARSE_MEANS = f"""{sql.coarse(4, 'c4')}, d4 AS (SELECT *, close - lag(close) OVER c AS d,
  greatest(high - low, abs(high - lag(close) OVER c), abs(low - lag(close) OVER c)) AS tr FROM c4 {_BY_BAR}),
u4 AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM d4),
m4 AS (SELECT *, {sql.mean('up', 1 / 14, 'bar')} AS mu, {sql.mean('down', 1 / 14, 'bar')} AS md,
  {sql.mean('tr', 1 / 14, 'bar')} AS atr, {sql.mean('close', 2 / 13, 'bar')} - {sql.mean('close', 2 / 27, 'bar')} AS m FROM u4),
s4 AS (SELECT *, {sql.mean('m', 2 / 10, 'bar')} AS sig FROM m4)"""


@query(f"""WITH {sql.BARS}, {_COARSE_MEANS} SELECT b.symbol, b.ts, round(100 - 100 / (1 + f.mu / (f.md + 1e-12)), 5) + 0 AS tf4h_rsi_14,
round((f.m - f.sig) / (f.close + 1e-12), 6) + 0 AS tf4h_macd_hist, round(f.atr / (f.close + 1e-12), 6) + 0 AS tf4h_atr_norm
FROM bars b ASOF LEFT JOIN s4 f ON f.symbol = b.symbol AND b.ts + INTERVAL 1 HOUR >= f.bar + INTERVAL 4 HOUR""")
def mtf_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """RSI, MACD and ATR of the latest closed four-hour bar."""
    bars = source.hourly(spark, folder)
    df = features.align_coarse(bars, features.coarse_features(bars, 4), 4)
    rsi = rounded(F.col("tf4h_rsi_14"), 5).alias("tf4h_rsi_14")
    return df.select("symbol", "ts", rsi, *[rounded(F.col(c)).alias(c) for c in ("tf4h_macd_hist", "tf4h_atr_norm")])


@query(f"""WITH {sql.BARS}, {_COARSE}, a AS (SELECT b.*, f.tf4h_trend FROM bars b ASOF LEFT JOIN f4 f ON f.symbol = b.symbol AND b.ts + INTERVAL 1 HOUR >= f.bar + INTERVAL 4 HOUR),
j AS (SELECT a.*, f.tf24h_trend, sign(close / lag(close, 14) OVER (PARTITION BY a.symbol ORDER BY ts) - 1) AS side FROM a ASOF LEFT JOIN f24 f ON f.symbol = a.symbol AND a.ts + INTERVAL 1 HOUR >= f.bar + INTERVAL 24 HOUR),
v AS (SELECT symbol, ts, coalesce(tf4h_trend, 0) + 0 AS tf4h_trend, coalesce(tf24h_trend, 0) + 0 AS tf24h_trend,
  (coalesce(side, 0) * coalesce(tf4h_trend, 0) > 0)::DOUBLE AS tf4h_agree, (coalesce(side, 0) * coalesce(tf24h_trend, 0) > 0)::DOUBLE AS tf24h_agree FROM j)
SELECT *, (tf4h_agree + tf24h_agree) / 2 AS mtf_confluence FROM v""")
def mtf_confluence(spark: SparkSession, folder: str) -> DataFrame:
    bars = source.hourly(spark, folder)
    df = bars.withColumn("mom_14", W.momentum(F.col("close"), 14))
    for hours in (4, 24):
        df = features.align_coarse(df, features.coarse_features(bars, hours, indicators=False).select("symbol", "ts", f"tf{hours}h_trend"), hours)
    out = features.confluence(df, F.signum("mom_14"), ["tf4h_trend", "tf24h_trend"])
    return shown(out, "tf4h_trend", "tf24h_trend", "tf4h_agree", "tf24h_agree", "mtf_confluence")


@query(f"""WITH {sql.BARS}, l AS (SELECT *, ln(close + 1e-9) - ln(lag(close) OVER w + 1e-9) AS lr, row_number() OVER w AS rn FROM bars {sql.W})
SELECT symbol, ts, round(CASE WHEN rn >= 8 THEN avg(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 22 PRECEDING) * 24
  / ((stddev_pop(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 62 PRECEDING) + 1e-6) * sqrt(24)) ELSE 0 END, 6) + 0 AS score FROM l""")
def tsfm_naive_scores(spark: SparkSession, folder: str) -> DataFrame:
    from barflow.operators.learning import naive_scores

    return shown(naive_scores(source.hourly(spark, folder)), "score")


@query(f"""WITH {sql.BARS}, f AS (SELECT symbol, ts, (epoch(ts)::BIGINT % 7)::DOUBLE / 1000 AS funding_rate, volume AS open_interest FROM bars WHERE epoch(ts)::BIGINT % 28800 = 0),
j AS (SELECT b.*, f.funding_rate, f.open_interest FROM bars b ASOF LEFT JOIN f ON f.symbol = b.symbol AND b.ts >= f.ts)
SELECT symbol, ts, round(coalesce((funding_rate - {sql.rolling('avg', 'funding_rate', 50)}) / ({sql.rolling('stddev_samp', 'funding_rate', 50)} + 1e-12), 0), 6) + 0 AS funding_z,
  round(coalesce(open_interest / lag(open_interest, 24) OVER w - 1, 0), 6) + 0 AS oi_change FROM j {sql.W}""")
def derivatives_ffill(spark: SparkSession, folder: str) -> DataFrame:
    from barflow.operators.asof import asof

    bars = source.hourly(spark, folder)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rates = bars.filter(F.pmod(seconds, F.lit(28800)) == 0).select(
        "symbol", F.col("ts").alias("at"), (F.pmod(seconds, F.lit(7)) / F.lit(1000.0)).alias("funding_rate"), F.col("volume").alias("open_interest")
    )
    df = asof(bars, rates, F.col("ts"), F.col("at"), ["funding_rate", "open_interest"])
    z = W.zscore(F.col("funding_rate"), 50)
    df = df.withColumns({"funding_z": F.coalesce(W.finite(z), F.lit(0.0)), "oi_change": F.coalesce(W.finite(W.momentum(F.col("open_interest"), 24)), F.lit(0.0))})
    return shown(df, "funding_z", "oi_change")


@query(f"""WITH {sql.BARS}, p AS (SELECT *, close / lag(close, 7) OVER w - 1 AS ret_7, close / lag(close, 14) OVER w - 1 AS ret_14 FROM bars {sql.W})
SELECT symbol, max(ts) AS ts, round(arg_max(ret_7, ts), 6) + 0 AS ret_7, round(arg_max(ret_14, ts), 6) + 0 AS ret_14, count(*) AS n_complete
FROM p WHERE ret_7 IS NOT NULL AND ret_14 IS NOT NULL GROUP BY symbol""")
def latest_complete_bar(spark: SparkSession, folder: str) -> DataFrame:
    close = F.col("close")
    panel = source.hourly(spark, folder).withColumns({"ret_7": W.momentum(close, 7), "ret_14": W.momentum(close, 14)})
    rows = features.complete_rows(panel)
    last = rows.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("ret_7", "ts").alias("ret_7"), F.max_by("ret_14", "ts").alias("ret_14"), F.count(F.lit(1)).alias("n_complete"))
    return last.select("symbol", "ts", rounded(F.col("ret_7")).alias("ret_7"), rounded(F.col("ret_14")).alias("ret_14"), "n_complete")


@query(f"""WITH {sql.BARS}, t AS (SELECT symbol, ts, [coalesce(lag(close, 3) OVER w, 0), coalesce(lag(close, 2) OVER w, 0), coalesce(lag(close, 1) OVER w, 0), close] AS x FROM bars {sql.W})
SELECT symbol, ts, round(x[1], 6) + 0 AS x0, round(x[2], 6) + 0 AS x1, round(x[3], 6) + 0 AS x2, round(x[4], 6) + 0 AS x3 FROM t""")
def lookback_tensor(spark: SparkSession, folder: str) -> DataFrame:
    seen = F.collect_list("close").over(W.series().rowsBetween(-3, 0))
    padded = F.concat(F.array_repeat(F.lit(0.0), 4 - F.size(seen)), seen)
    df = source.hourly(spark, folder).withColumn("x", padded)
    return shown(df.select("symbol", "ts", *[F.col("x")[k].alias(f"x{k}") for k in range(4)]), "x0", "x1", "x2", "x3")


@query()
def feature_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The whole technical panel; its columns have SQL one by one above."""
    return features.technical(source.hourly(spark, folder))


@query("""WITH t AS (SELECT ts, event_id AS tick_id, value AS price FROM events WHERE value > 0)
SELECT ts, tick_id, round(CASE WHEN count(*) OVER w = 100 THEN avg(price) OVER w END, 6) + 0 AS mean_100, round(max(price) OVER w, 6) + 0 AS max_100
FROM t WINDOW w AS (ORDER BY ts, tick_id ROWS 99 PRECEDING)""")
def one_series_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling mean and highest price over all ticks as one series, in blocks with halos: no task has the series."""
    ticks = source.ticks(spark, folder).withColumn("symbol", F.lit("all"))

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {"mean_100": W.rolling(F.avg, F.col("price"), 100, w), "max_100": F.max("price").over(w.rowsBetween(-99, 0))}

    df = chunks.with_frames(ticks, 100, columns, order=("ts", "tick_id"))
    return df.select("ts", "tick_id", rounded(F.col("mean_100")).alias("mean_100"), rounded(F.col("max_100")).alias("max_100"))


@query(f"""WITH {sql.BARS}, h AS (SELECT ts, max(high) AS high FROM bars GROUP BY ts)
SELECT tick_id, t.ts, h.ts AS bar, round(h.high, 6) + 0 AS high FROM ticks t ASOF LEFT JOIN h ON t.ts >= h.ts + INTERVAL 1 HOUR""")
def one_series_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Each tick with the highest price of the last hour that had ended, all ticks being one series that is cut into stretches."""
    ticks = source.ticks(spark, folder).select("ts", "tick_id").withColumn("symbol", F.lit("all"))
    high = source.hourly(spark, folder).groupBy("ts").agg(F.max("high").alias("high")).withColumns({"symbol": F.lit("all"), "bar": F.col("ts")})
    df = asof_stretches(ticks, high, F.col("ts"), F.col("ts") + F.expr("interval 1 hour"), ["bar", "high"])
    return df.select("tick_id", "ts", "bar", rounded(F.col("high")).alias("high"))
