"""Known answers: barriers, visibility, accounting, folds, sizes."""

import bisect
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.functions import text as T
from barflow.functions import timeframes
from barflow.operators import backtest, calibration, chunks, ewm, features, labels, learning, metrics, news, validation
from barflow.operators.asof import asof, asof_stretches
from barflow.operators.backtest import Rules
from barflow.operators.chunks import expanding_median

START = dt.datetime(2024, 1, 1)


def hour(k):
    return START + dt.timedelta(hours=k)


def path(spark, highs=None, lows=None, closes=None, n=5, trgt=0.01, side=1.0):
    rows = []
    for k in range(n):
        close = closes[k] if closes else 100.0
        rows.append(("s", hour(k), (highs or {}).get(k, close), (lows or {}).get(k, close), close, trgt, side))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double, trgt double, side double")


def first_label(df, ahead=4, **kw):
    return labels.first_touch(df, 1.0, 1.0, ahead, **kw).orderBy("t0").first()


@pytest.mark.parametrize(
    "highs, lows, closes, side, bin_",
    [
        ({2: 102.0}, {}, None, 1.0, 1),
        ({}, {2: 98.0}, None, 1.0, 0),
        ({2: 102.0}, {2: 98.0}, None, 1.0, 0),
        ({}, {}, [100.0, 100.1, 100.2, 100.3, 100.5], 1.0, 1),
        ({}, {}, [100.0, 100.1, 100.2, 100.3, 100.5], -1.0, 0),
        ({}, {0: 90.0}, None, 1.0, 0),
    ],
)
def test_barriers(spark, highs, lows, closes, side, bin_):
    row = first_label(path(spark, highs, lows, closes, side=side))
    assert row["bin"] == bin_
    if closes is None and 2 in (lows or {}) and side > 0:
        assert row["bars_held"] == 2 and row["ret"] < 0


def test_short_vertical_return(spark):
    row = first_label(path(spark, closes=[100.0, 99.0, 98.0, 97.0, 95.0], trgt=0.5, side=-1.0))
    assert row["ret"] == pytest.approx(0.04879016416943205)


def test_labels_beyond_the_data_are_dropped(spark):
    assert labels.first_touch(path(spark), 1.0, 1.0, 5).count() == 0


def test_expanding_median_starts_at_the_prior(spark):
    rows = [("s", hour(k), 0.001 if k < 60 else 0.05) for k in range(100)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trgt double")
    got = [r[0] for r in expanding_median(df, "trgt", "m").orderBy("ts").select("m").collect()]
    assert got[:49] == [0.005] * 49 and got[49] == 0.001


def plain_cusum(closes, limits):
    up = down = 0.0
    out = []
    for k, (close, limit) in enumerate(zip(closes, limits)):
        move = math.log(close) - math.log(closes[k - 1]) if k else 0.0
        up, down = max(0.0, up + move), min(0.0, down + move)
        fell = down < -limit
        rose = not fell and up > limit
        up, down = 0.0 if rose else up, 0.0 if fell else down
        out.append(fell or rose)
    return out


def test_a_series_of_many_stretches_has_the_medians_and_events_of_one(spark):
    """Noise, trends that never let a sum forget its start, ties, gaps and nulls; the longest series is cut into many stretches."""
    rng = random.Random(5)
    series = {
        "noise": [100 * math.exp(rng.gauss(0, 0.1)) for _ in range(5000)], "rise": [100 * 1.003**k for k in range(3000)],
        "fall": [100 * 0.996**k for k in range(1500)], "flat": [100.0] * 1200, "short": [100.0, 200.0],
    }
    rows = []
    for name, closes in series.items():
        for k, close in enumerate(closes):
            x = None if rng.random() < 0.1 else rng.choice([0.01, 0.02, rng.random(), k / 1e4])
            rows.append((name, hour(k + (4000 if k > 700 else 0)), close, x))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, x double").repartition(7)
    got = {(r["symbol"], r["ts"]): r["m"] for r in expanding_median(df, "x", "m", 10, 0.5).collect()}
    assert len(got) == len(rows)
    seen = {}
    for name, ts, _, x in rows:
        known = seen.setdefault(name, [])
        if x is not None:
            bisect.insort(known, x)
        want = statistics.median(known) if len(known) >= 10 else 0.5
        assert got[name, ts] == pytest.approx(want, rel=1e-12)
    found = {(r["symbol"], r["ts"]) for r in labels.cusum_events(df, F.lit(0.05)).collect()}
    of = {}
    for name, ts, close, _ in rows:
        of.setdefault(name, []).append((ts, close))
    want = {(name, ts) for name, bars in of.items() for (ts, _), hit in zip(bars, plain_cusum([c for _, c in bars], [0.05] * len(bars))) if hit}
    assert found == want and len(want) > 500


def test_stretches_with_halos_equal_whole_series(spark):
    """Bursts, gaps and a second, short series; blocks of 32 rows, so that frames and carried rows cross many of them."""
    rng = random.Random(8)
    at, rows = 0, []
    for k in range(700):
        at += 1 if k < 300 else rng.choice([1, 60, 86_400])
        rows.append(("s" if k % 50 else "t", START + dt.timedelta(seconds=at), k, rng.random()))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, k long, x double").repartition(5)
    w = Window.partitionBy("symbol").orderBy("ts", "k")
    want = {(r["k"], r["s"], r["rn"]) for r in df.select("k", F.sum("k").over(w.rowsBetween(-19, 0)).alias("s"), (F.row_number().over(w) - 1).alias("rn")).collect()}
    framed = chunks.with_frames(df, 20, lambda v: {"s": F.sum("k").over(v.rowsBetween(-19, 0))}, 32, order=("ts", "k"))
    got = chunks.numbered(framed, "rn", 32, order=("ts", "k")).collect()
    assert {(r["k"], r["s"], r["rn"]) for r in got} == want and len(got) == 700
    right = df.filter("k % 9 = 0").select("symbol", "ts", F.col("k").alias("v"))
    left = df.select("symbol", "ts", "k")
    whole, cut = (f(left, right, F.col("ts"), F.col("ts") + F.expr("interval 30 seconds"), ["v"]) for f in (asof, lambda *a: asof_stretches(*a, rows=32)))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    assert chunks.chunked(df, 32).select("symbol", "_chunk").distinct().count() > 5


def test_a_coarse_bar_is_seen_once_it_has_closed(spark):
    main = spark.createDataFrame([("s", hour(k)) for k in range(8, 16)], "symbol string, ts timestamp_ntz")
    aux = spark.createDataFrame([("s", hour(8), 99.0)], "symbol string, ts timestamp_ntz, v double")
    rows = asof(main, aux, F.col("ts") + F.expr("interval 1 hour"), F.col("ts") + F.expr("interval 4 hours"), ["v"])
    got = {r["ts"].hour: r["v"] for r in rows.collect()}
    assert got[8] is None and got[9] is None and got[10] is None and got[11] == 99.0 and got[15] == 99.0


def test_news_is_seen_after_its_buffer_and_expires(spark):
    bars = spark.createDataFrame([("s", hour(k)) for k in range(8, 40)], "symbol string, ts timestamp_ntz")
    panel = spark.createDataFrame([("s", hour(10), "t", 0.5, 1, 1.0, 1)], "symbol string, bucket_end timestamp_ntz, text string, sentiment double, n_items int, max_authority double, corroboration int")
    got = {r["ts"]: r for r in news.align_panel(bars, panel, ttl_hours=1).collect()}
    assert got[hour(9)]["has_recent_news"] == 0 and got[hour(10)]["has_recent_news"] == 1
    assert got[hour(13)]["news_sentiment_raw"] == 0 and got[hour(13)]["news_text"] == ""


def test_corroboration_is_point_in_time(spark):
    items = spark.createDataFrame(
        [(1, "s", hour(0), "big coin fund approved today", "a:x", 3), (2, "s", hour(6), "big coin fund approved today!", "b", 1)],
        "item_id long, symbol string, published_at timestamp_ntz, title string, source string, tier int",
    ).withColumn("body", F.col("title"))
    got = {r["item_id"]: (r["corroboration"], r["tier"], r["sources"]) for r in news.snapshots(items).collect()}
    assert got == {1: (1, 3, "a"), 2: (2, 1, "a,b")}


def events(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, side double, ret double, bin int, bars_held int, prob double, confident boolean")


def prices(spark, closes):
    return spark.createDataFrame([("s", hour(k), float(c)) for k, c in enumerate(closes)], "symbol string, ts timestamp_ntz, close double")


def test_gains_add_on_the_equity_at_entry(spark):
    from math import log1p

    rules = Rules(fee=0, slip=0, max_position=0.5, kelly=10.0, daily_drawdown=0.0)
    rows = [("s", hour(0), hour(2), 1.0, log1p(0.1), 1, 2, 0.9, True), ("s", hour(1), hour(3), 1.0, log1p(0.1), 1, 2, 0.9, True)]
    points = backtest.portfolio(events(spark, rows), prices(spark, [100] * 5), rules, "points")
    assert [r["equity"] for r in points.filter("equity is not null").orderBy("seq").collect()] == pytest.approx([1.05, 1.10])


def test_a_short_is_marked_by_its_simple_return(spark):
    rules = Rules(fee=0, slip=0, kelly=10.0, max_position=0.3, daily_drawdown=0.0)
    rows = [("s", hour(0), hour(4), -1.0, 0.0, 1, 4, 0.9, True), ("s", hour(2), hour(5), -1.0, 0.0, 1, 3, 0.1, True)]
    points = backtest.portfolio(events(spark, rows), prices(spark, [100, 100, 90, 90, 90, 90]), rules, "points")
    assert points.filter(F.col("ts") == F.lit(hour(2))).first()["marked"] == pytest.approx(1 + 0.1 * 0.3)


def test_nothing_trades_without_confidence(spark):
    rows = [("s", hour(0), hour(2), 1.0, 0.1, 1, 2, 0.9, False)]
    got = backtest.portfolio(events(spark, rows), prices(spark, [100] * 4), Rules()).collect()
    assert [r["size"] for r in got] == [0.0]


def test_ledger_reconciles_and_exposure_is_capped(spark, sf_dir):
    from barflow.plans import trading

    rules, scored = trading.RULES, trading.scored(spark, sf_dir)
    detail = backtest.portfolio(scored, trading.panel(spark, sf_dir), rules)
    points = backtest.portfolio(scored, trading.panel(spark, sf_dir), rules, "points").filter("equity is not null")
    ends = {r["symbol"]: r["e"] for r in points.groupBy("symbol").agg(F.max_by("equity", F.struct("ts", "seq")).alias("e")).collect()}
    sums = {r["symbol"]: 1 + r["g"] for r in detail.groupBy("symbol").agg(F.sum(F.col("entry_equity") * F.col("pnl")).alias("g")).collect()}
    assert all(sums[s] == pytest.approx(e) for s, e in ends.items())
    peaks = metrics.peak_exposure(detail.filter("size > 0")).collect()
    assert all(r["peak"] <= rules.max_gross + 1e-9 for r in peaks)


def test_no_train_label_meets_the_test_fold(spark, sf_dir):
    from barflow.plans import labels as plans

    folds = validation.purged_folds(plans.all_labels(spark, sf_dir), 5, 0.02)
    row = validation.overlaps(folds).agg(F.sum("n_overlaps"), F.sum("n_before_purge")).first()
    assert row[0] == 0 and row[1] > 0


def test_features_do_not_read_the_future(spark, sf_dir):
    from barflow.sources.bars import hourly

    bars = hourly(spark, sf_dir).filter("symbol = 'view'").persist()
    cut = bars.filter("ts < timestamp_ntz '2024-01-15'")
    whole = {r["ts"]: r["macd"] for r in ewm.macd(bars).collect()}
    early = {r["ts"]: r["macd"] for r in ewm.macd(cut).collect()}
    assert early and all(whole[t] == pytest.approx(v, abs=1e-9) for t, v in early.items())


def test_means_across_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ewm, "CHUNK", 7)
    values = [float((k * 37) % 11) for k in range(100)]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(values)], "symbol string, ts long, x double")
    got = [r["y"] for r in ewm.ewm(df, {"y": ("x", 0.3)}).orderBy("ts").collect()]
    want = [values[0]]
    for x in values[1:]:
        want.append(0.3 * x + 0.7 * want[-1])
    assert got == pytest.approx(want)


def test_decision_levels_and_guards(spark):
    row = spark.range(1).select(*[
        c.alias(k) for k, c in backtest.decide(F.lit(0.7), F.lit(1), F.lit(100.0), F.lit(2.0), F.lit(True), Rules(take=2.0, stop=1.5)).items()
    ]).first()
    assert (row["signal"], row["stop_loss"], row["take_profit"], row["reason"]) == ("LONG", 97.0, 104.0, None)
    with pytest.raises(ValueError):
        Rules(execution="next_open")


def test_lexicon_uses_whole_words(spark):
    rows = spark.createDataFrame([("Banks issue gains against fear",), ("ETF approved, record inflow; 利好",), ("hack and ban",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.sentiment(F.col("t"))).collect()] == [0.0, 1.0, -1.0, 0.0]
    assert [r[0] for r in rows.select(T.language(F.col("t"))).collect()] == ["en", "en", "en", "en"]


def test_weights_of_fractional_differences():
    assert len(features.ffd_weights(0.4, 1e-4)) == 282 and len(features.ffd_weights(0.4, 1e-2)) == 11


def test_deflated_sharpe(spark):
    from statistics import NormalDist

    rows = spark.createDataFrame([(0.0, 100), (0.9, 100), (0.1, 1)], "sr double, n long")
    low, high, none = (r[0] for r in rows.select(metrics.deflated_sharpe(F.col("sr"), 50, F.col("n"))).collect())
    assert low < 0.05 < 0.5 < high and none is None
    z = spark.createDataFrame([(float(x) / 4,) for x in range(-20, 21)], "z double")
    assert all(r[1] == pytest.approx(NormalDist().cdf(r[0]), abs=1e-7) for r in z.select("z", metrics.normal_cdf(F.col("z"))).collect())


def labelled(spark, bins, ahead=2):
    rows = [("s", hour(k), hour(k + ahead), 1.0, 0.01 if b else -0.01, b, ahead) for k, b in enumerate(bins)]
    return spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, side double, ret double, bin int, bars_held int")


def test_the_expert_reads_ended_labels_only(spark):
    bins = [(k * 7) % 3 > 0 for k in range(40)]
    got = {r["t0"]: r for r in learning.hit_rate(labelled(spark, list(map(int, bins))), last=5).collect()}
    for k in range(40):
        ended = [b for j, b in enumerate(bins) if j + 2 <= k][-5:]
        assert got[hour(k)]["prob"] == pytest.approx(round((sum(ended) + 1) / (len(ended) + 2), 4), abs=1e-9)
        assert got[hour(k)]["confident"] == (len(ended) == 5)


def test_a_day_is_halted_by_its_own_losses(spark):
    from math import log

    rules = Rules(fee=0, slip=0, kelly=10.0, max_position=0.3, daily_drawdown=0.05)
    rows = [("s", hour(k), hour(k + 1), 1.0, log(0.8), 0, 1, 0.9, True) for k in range(4)] + [("s", hour(24 + k), hour(25 + k), 1.0, log(0.99), 0, 1, 0.9, True) for k in range(3)]
    got = backtest.independent(events(spark, rows), rules).orderBy("t0").collect()
    assert [r["halted"] for r in got] == [False, True, True, True, False, False, False]
    assert got[3]["equity"] == pytest.approx(0.94) and got[6]["equity"] == pytest.approx(0.94 * 0.997**3)


def test_weak_and_frozen_experts_stay_out(spark):
    rows = []
    for k in range(60):
        b = k % 2
        rows += [("s", hour(k), hour(k + 1), "good", 0, 0.4 + 0.2 * b, b, 1.0), ("s", hour(k), hour(k + 1), "bad", 0, 0.6 - 0.2 * b, b, 1.0), ("s", hour(k), hour(k + 1), "frozen", 0, float(b), b, 1.0)]
    oof = spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, expert string, fold int, prob double, bin int, w double")
    got = {r["expert"]: (r["kept"], r["reason"]) for r in learning.select_experts(oof, pseudo=("frozen",)).collect()}
    assert got == {"good": (True, None), "bad": (False, "low_auc"), "frozen": (False, "not_refitted_in_folds")}
    only = {r["expert"]: (r["kept"], r["reason"]) for r in learning.select_experts(oof.filter("expert = 'bad'")).collect()}
    assert only == {"bad": (True, "best_of_weak_experts")}


def test_few_rows_are_said_to_be_few(spark):
    rows = [("s", hour(k), hour(k + 1), "a", k % 2, 0.5 + 0.01 * k, k % 2, 1.0) for k in range(3)]
    oof = spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, expert string, fold int, prob double, bin int, w double")
    assert all(r["fallback"] for r in learning.stack(oof).collect())
    one_class = labelled(spark, [1] * 30).withColumn("prob", F.lit(0.6))
    got = calibration.cross_fit(one_class).collect()
    assert all(r["confident"] and r["tag"] == "conformal_fold_skipped" and r["calibrated"] == 1.0 for r in got)
    few = calibration.cross_fit(labelled(spark, [1, 0, 1]).withColumn("prob", F.lit(0.6))).collect()
    assert all(r["calibrated"] is None and r["confident"] for r in few)
    _, said = calibration.deploy_fit(labelled(spark, [1, 0] * 10).withColumn("prob", F.lit(0.6)))
    assert said.first()["tag"] == "fitted_and_judged_on_the_same_rows"


def test_isotonic_fit_pools_what_falls(spark):
    rows = [("s", 0.1, 0)] * 4 + [("s", 0.3, 1)] * 2 + [("s", 0.4, 0)] * 2 + [("s", 0.8, 1)] * 3
    fit = calibration.isotonic(spark.createDataFrame(rows, "symbol string, prob double, bin int"), "prob", "bin", ["symbol"])
    got = {r["point"]: r["value"] for r in fit.collect()}
    assert len(got) == 101 and (got[0], got[10], got[30], got[40], got[80], got[100]) == (0, 0, 0.5, 0.5, 1, 1)
    assert got[20] == pytest.approx(0.25) and got[60] == pytest.approx(0.75)


def test_early_stopping_never_validates_on_the_future(spark):
    split = learning.early_stop_split(labelled(spark, [1, 0] * 20), F.lit(hour(20)), 0.25).collect()
    chosen = [r["t0"] for r in split if r["is_val"]]
    assert chosen and max(chosen) < hour(20) and all(r["t1"] < hour(20) for r in split if r["is_val"])


def test_schema_mismatch_holds_and_sources_are_refused(spark):
    bars = prices(spark, [100, 101])
    df, missing = features.align_schema(bars, ["close", "x", "y"])
    rows = backtest.hold_for_schema(df, missing).collect()
    assert missing == ["x", "y"] and all(r["signal"] == "HOLD" and r["stop_loss"] is None and not r["confident"] for r in rows)
    assert backtest.hold_for_schema(bars, []).count() == 0
    news.check_sources(True, True)
    for bad in ((False, True, ()), (False, False, ("synthetic",))):
        with pytest.raises(ValueError):
            news.check_sources(*bad)


def test_times_in_the_spellings_of_feeds(spark):
    rows = spark.createDataFrame([("Mon, 1 Jan 2024 10:00:00 GMT",), ("1 Jan 2024 12:00:00 +0200",), ("2024-01-01T10:00:00Z",), ("soon",), (None,)], "t string")
    got = [r[0] for r in rows.select(F.date_format(T.parse_time(F.col("t")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-01-01 10:00"] * 3 + [None, None]


def test_the_audit_passes(spark, sf_dir):
    from barflow.queries import QUERIES

    rows = QUERIES["audit"](spark, sf_dir).collect()
    assert len(rows) == 22 and all(r["status"] == "PASS" for r in rows), rows


def test_timeframes():
    assert timeframes.seconds("4h") == 14400 and timeframes.prefix("1d") == "tf1d" and timeframes.check_coarser("1h", "4h") == 4
    for main, other in (("4h", "1h"), ("1h", "1h"), ("1h", "7h")):
        with pytest.raises(ValueError):
            timeframes.check_coarser(main, other)
    names = ["close", "tf4h_trend", "tf15m_ret_1", "tf_x", "mtf_confluence", "xtf4h_a"]
    assert timeframes.coarse_columns(names) == ["tf4h_trend", "tf15m_ret_1", "mtf_confluence"]


def test_little_news_is_refused(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "symbol string, has_recent_news double")
    news.require_coverage(df, 0.5)
    with pytest.raises(ValueError, match="a 0.500"):
        news.require_coverage(df, 0.6)


def test_a_logistic_curve_calibrates(spark):
    """Probabilities that are too sure become the shares that they stand for; order stays."""
    rows = [(p, int(k < share * 200)) for p, share in ((0.1, 0.3), (0.5, 0.5), (0.9, 0.7)) for k in range(200)]
    df = spark.createDataFrame(rows, "prob double, bin int")
    got = {r["prob"]: r["calibrated"] for r in learning.calibrate(df, df, kind="platt").distinct().collect()}
    assert got[0.1] == pytest.approx(0.3, abs=0.02) and got[0.5] == pytest.approx(0.5, abs=0.02) and got[0.9] == pytest.approx(0.7, abs=0.02)


def test_texts_of_decisions(spark):
    rows = [("s", hour(1), "LONG", 0.7, 100.0, 97.5, None, 0.1, 1.5, None), ("s", hour(1), "HOLD", None, 1.0, None, None, 0.0, 1.0, "not_cusum_event"), ("s", hour(1), "HOLD", 0.5, 1.0, None, None, 0.0, 1.0, "other")]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, signal string, win_probability double, entry_price double, stop_loss double, take_profit double, suggested_position_pct double, atr double, reason string")
    long, held, other = [r[0] for r in df.select(backtest.decision_text()).collect()]
    assert long.split("\n")[0] == "[做多 LONG] s" and "止损:     97.5" in long and "止盈:     None" in long and long.endswith("2024-01-01 01:00:00")
    assert backtest.HOLD_TEXTS["not_cusum_event"] in held and "概率=None" in held and "原因: other" in other
