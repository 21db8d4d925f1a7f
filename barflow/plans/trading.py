"""Queries over scores, sizes, decisions and back-tests."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions.windows import momentum, rounded, series
from barflow.operators import audit as checks
from barflow.operators import backtest, calibration, features, labels, learning, lifecycle, metrics, validation
from barflow.operators.backtest import Rules
from barflow.plans import sql
from barflow.plans.features import shown
from barflow.plans.labels import _CUSUM, GROUPS, all_labels, panel, scored
from barflow.plans.registry import query
from barflow.sources import bars as source
from barflow.stored import shared_folder, stored

RULES = Rules()


_AUC = """ra AS (SELECT symbol, bin, rank() OVER (PARTITION BY symbol ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, prob) - 1) / 2.0::DOUBLE AS r FROM pe),
au AS (SELECT symbol, (sum(r) FILTER (bin = 1) - sum(bin) * (sum(bin) + 1) / 2.0::DOUBLE) / (sum(bin) * (count(*) - sum(bin))) AS auc FROM ra GROUP BY symbol)"""


@query(f"WITH {sql.EVENTS}, {sql.PROBS}, {_AUC} SELECT symbol, round(auc, 6) + 0 AS auc FROM au")
def auc_rank(spark: SparkSession, folder: str) -> DataFrame:
    return shown(metrics.auc(scored(spark, folder), "prob", "bin", ["symbol"]), "auc", keys=("symbol",))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_AUC}, c AS (SELECT *, least(greatest(prob, 1e-6), 1 - 1e-6) AS p FROM pe)
SELECT symbol, count(*) AS n, round(any_value(auc), 6) + 0 AS auc, round(avg((prob - bin) ^ 2), 6) + 0 AS brier, round(avg(-(bin * ln(p) + (1 - bin) * ln(1 - p))), 6) + 0 AS logloss,
round(avg(((prob > 0.5)::INT = bin)::INT), 6) + 0 AS accuracy, round(avg(bin), 6) + 0 AS base_rate FROM c JOIN au USING (symbol) GROUP BY symbol""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.classification_report(scored(spark, folder), "prob", "bin", ["symbol"])
    return shown(out, "auc", "brier", "logloss", "accuracy", "base_rate", keys=("symbol", "n"))


_QHAT = """sc AS (SELECT symbol, CASE WHEN bin = 1 THEN 1 - prob ELSE prob END AS score FROM pe),
qh AS (SELECT symbol, least(ceil((count(*) + 1) * (1 - 0.1::DOUBLE)) / count(*), 1) AS q, list_sort(list(score)) AS s FROM sc GROUP BY symbol),
qq AS (SELECT symbol, s[floor(q * (len(s) - 1))::INT + 1] + (q * (len(s) - 1) - floor(q * (len(s) - 1))) * (s[ceil(q * (len(s) - 1))::INT + 1] - s[floor(q * (len(s) - 1))::INT + 1]) AS qhat FROM qh)"""


@query(f"WITH {sql.EVENTS}, {sql.PROBS}, {_QHAT} SELECT symbol, round(qhat, 6) + 0 AS qhat FROM qq")
def conformal_qhat(spark: SparkSession, folder: str) -> DataFrame:
    return shown(metrics.conformal_quantile(scored(spark, folder), "prob", "bin", ["symbol"]), "qhat", keys=("symbol",))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_QHAT} SELECT symbol, t0, 1 - prob <= round(qhat, 6) AS in_class1, prob <= round(qhat, 6) AS in_class0,
(1 - prob <= round(qhat, 6)) <> (prob <= round(qhat, 6)) AS confident FROM pe JOIN qq USING (symbol)""")
def conformal_flags(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder).drop("confident")
    q = metrics.conformal_quantile(df, "prob", "bin", ["symbol"]).withColumn("qhat", F.round("qhat", 6))
    joined = df.join(F.broadcast(q), "symbol")  # a row per symbol
    return joined.withColumns(metrics.conformal_flags(F.col("prob"), F.col("qhat"))).select("symbol", "t0", "in_class1", "in_class0", "confident")


_SIZE = "least(greatest((prob * 2 - 1 - 0.0014::DOUBLE) / 1, 0) * 0.5::DOUBLE, 0.3::DOUBLE)"


@query(f"WITH {sql.EVENTS}, {sql.PROBS} SELECT symbol, t0, round({_SIZE}, 6) + 0 AS size FROM pe")
def kelly_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return shown(scored(spark, folder).withColumn("size", backtest.position_size(F.col("prob"), RULES)), "size", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, d AS (SELECT *, trgt * close AS atr, {_SIZE} AS size FROM pe),
r AS (SELECT *, CASE WHEN NOT confident THEN 'low_confidence_conformal' WHEN side = 0 THEN 'no_side' WHEN prob < 0.55::DOUBLE THEN 'prob_below_threshold'
  WHEN size <= 0 THEN 'kelly_non_positive_after_cost' END AS reason FROM d)
SELECT symbol, t0, CASE WHEN reason IS NOT NULL THEN 'HOLD' WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS signal, round(prob, 4) AS win_probability,
round(close, 2) AS entry_price, CASE WHEN reason IS NOT NULL THEN 0 ELSE round(size, 4) END AS suggested_position_pct,
CASE WHEN reason IS NULL THEN round(close - side * 1.5::DOUBLE * atr, 2) + 0 END AS stop_loss, CASE WHEN reason IS NULL THEN round(close + side * 1.5::DOUBLE * atr, 2) + 0 END AS take_profit, reason FROM r""")
def decide_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder).withColumn("_atr", F.col("trgt") * F.col("close"))
    columns = backtest.decide(F.col("prob"), F.col("side"), F.col("close"), F.col("_atr"), F.col("confident"), RULES)
    levels = {c: columns[c] + F.lit(0.0) for c in ("stop_loss", "take_profit")}
    return df.withColumns({k: v for k, v in columns.items() if k != "atr"} | levels).select(
        "symbol", "t0", "signal", "win_probability", "entry_price", "suggested_position_pct", "stop_loss", "take_profit", "reason"
    )


_WHY = " ".join(f"WHEN reason = '{k}' THEN '{v}'" for k, v in backtest.HOLD_TEXTS.items())


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, d AS (SELECT *, trgt * close AS atr, {_SIZE} AS size FROM pe),
r AS (SELECT *, CASE WHEN NOT confident THEN 'low_confidence_conformal' WHEN side = 0 THEN 'no_side' WHEN prob < 0.55::DOUBLE THEN 'prob_below_threshold'
  WHEN size <= 0 THEN 'kelly_non_positive_after_cost' END AS reason FROM d)
SELECT symbol, t0, CASE WHEN reason IS NOT NULL THEN '[观望] ' || symbol || chr(10) || '概率=' || round(prob, 4) || '  (' || CASE {_WHY} END || ')' || chr(10) || '时间: ' || strftime(t0, '%Y-%m-%d %H:%M:%S')
  ELSE CASE WHEN side > 0 THEN '[做多 LONG] ' ELSE '[做空 SHORT] ' END || symbol END AS text FROM r""")
def decision_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What a notifier would send of each event: a hold's whole text, the first line of a trade's."""
    df = scored(spark, folder)
    columns = backtest.decide(F.col("prob"), F.col("side"), F.col("close"), F.col("trgt") * F.col("close"), F.col("confident"), RULES)
    text = backtest.decision_text("t0")
    whole = df.withColumns(columns).withColumn("text", text)
    return whole.select("symbol", "t0", F.when(F.col("signal") == "HOLD", F.col("text")).otherwise(F.substring_index("text", "\n", 1)).alias("text"))


#: Trades one by one; a day is halted from the trade after its running product falls to 95 %.
_TRADES = f"""tr1 AS (SELECT *, CASE WHEN confident AND prob >= 0.55::DOUBLE THEN {_SIZE} ELSE 0 END AS want FROM pe),
tr2 AS (SELECT *, want * (exp(ret) - 1) - want * 0.0014::DOUBLE AS gain FROM tr1),
tr3 AS (SELECT *, exp(sum(ln(1 + gain)) OVER (PARTITION BY symbol, t0::DATE ORDER BY t0 ROWS UNBOUNDED PRECEDING)) AS run FROM tr2),
tr4 AS (SELECT *, coalesce(min(run) OVER (PARTITION BY symbol, t0::DATE ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.95::DOUBLE, false) AS halted FROM tr3),
tr0 AS (SELECT *, CASE WHEN halted THEN 0 ELSE want END AS size FROM tr4),
trd AS (SELECT *, CASE WHEN halted THEN 0 ELSE gain END AS pnl FROM tr0),
eq AS (SELECT *, exp(sum(ln(1 + pnl)) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING)) AS equity FROM trd)"""


@query(f"WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES} SELECT symbol, t0, halted, round(size, 6) + 0 AS size, round(pnl, 6) + 0 AS pnl, round(equity, 6) + 0 AS equity FROM eq")
def independent_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return shown(backtest.independent(scored(spark, folder), RULES), "size", "pnl", "equity", keys=("symbol", "t0", "halted"))


_UNIQ = """tp AS (SELECT DISTINCT symbol, epoch_us(x) / 1e6 AS x FROM (SELECT symbol, t0 AS x FROM trd WHERE size > 0 UNION ALL SELECT symbol, t1 FROM trd WHERE size > 0)),
tg AS (SELECT symbol, x AS a, lead(x) OVER (PARTITION BY symbol ORDER BY x) AS b FROM tp),
tc AS (SELECT g.symbol, g.a, g.b, count(*) AS c FROM tg g JOIN trd e ON e.symbol = g.symbol AND e.size > 0 AND epoch_us(e.t0) / 1e6 <= g.a AND epoch_us(e.t1) / 1e6 >= g.b GROUP BY ALL),
tu AS (SELECT symbol, avg(u) AS uniq FROM (SELECT e.symbol, e.t0, sum((c.b - c.a) / c.c) / (any_value(epoch_us(e.t1) - epoch_us(e.t0)) / 1e6) AS u FROM trd e
  JOIN tc c ON c.symbol = e.symbol AND epoch_us(e.t0) / 1e6 <= c.a AND epoch_us(e.t1) / 1e6 >= c.b WHERE e.size > 0 GROUP BY ALL) GROUP BY symbol)"""


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, {_UNIQ}, pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
ro AS (SELECT symbol, count(*) AS n_events, count(*) FILTER (size > 0) AS n_trades, count(*) FILTER (halted) AS n_halted, arg_max(equity, t0) - 1 AS ret, min((equity - peak) / peak) AS dd,
  CASE WHEN count(*) FILTER (pnl <> 0) >= 2 AND stddev_pop(pnl) FILTER (pnl <> 0) > 0 THEN avg(pnl) FILTER (pnl <> 0) / (stddev_pop(pnl) FILTER (pnl <> 0) + 1e-12) ELSE 0 END AS sr,
  coalesce(avg((pnl > 0)::INT) FILTER (size > 0), 0) AS win, coalesce(avg(pnl) FILTER (size > 0), 0) AS mean, (epoch_us(max(t0)) - epoch_us(min(t0))) / 1e6 / 86400 AS days FROM pk GROUP BY symbol),
rp AS (SELECT ro.*, coalesce(uniq, 1) AS uniq, CASE WHEN n_events >= 2 AND n_trades * coalesce(uniq, 1) >= 2 AND days > 0 THEN n_trades * coalesce(uniq, 1) / (days / 365.25) ELSE 0 END AS ppy FROM ro LEFT JOIN tu USING (symbol))
SELECT symbol, n_events, n_trades, n_halted, round(ret, 6) + 0 AS total_return, round(dd, 6) + 0 AS max_drawdown, round(sr, 6) + 0 AS sharpe, round(sr * sqrt(ppy), 5) + 0 AS sharpe_annualized,
  round(uniq, 6) + 0 AS avg_uniqueness, round(n_trades * uniq, 5) + 0 AS n_trades_effective, round(ppy, 4) + 0 AS periods_per_year, round(win, 6) + 0 AS win_rate, round(mean, 6) + 0 AS avg_pnl,
  round(ret / (abs(dd) + 1e-9), 4) + 0 AS calmar FROM rp""")
def backtest_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of the independent back-test per symbol, annualised by the effective number of trades."""
    out = backtest.rollup(backtest.independent(scored(spark, folder), RULES))
    six = ("total_return", "max_drawdown", "sharpe", "avg_uniqueness", "win_rate", "avg_pnl")
    digits = {c: 6 for c in six} | {"sharpe_annualized": 5, "n_trades_effective": 5, "periods_per_year": 4, "calmar": 4}
    return out.select("symbol", "n_events", "n_trades", "n_halted", *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES} SELECT symbol, round(min((equity - peak) / peak), 6) + 0 AS max_drawdown
FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS peak FROM eq) GROUP BY symbol""")
def max_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    curve = backtest.independent(scored(spark, folder), RULES)
    return shown(metrics.drawdowns(curve, "equity", ["symbol"], ["t0"]), "max_drawdown", keys=("symbol",))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, st AS (SELECT symbol, t0, (equity - lag(equity) OVER w) / lag(equity) OVER w AS r FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY t0))
SELECT symbol, count(r) AS n_periods, round(avg(r) / (stddev_pop(r) + 1e-12), 6) + 0 AS sharpe,
round(avg(r) / (stddev_pop(r) + 1e-12) * sqrt(count(r) / ((epoch_us(max(t0)) - epoch_us(min(t0))) / 1e6 / (86400 * 365.25))), 6) + 0 AS sharpe_annualized FROM st GROUP BY symbol""")
def equity_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    curve = backtest.independent(scored(spark, folder), RULES)
    return shown(metrics.equity_sharpe(curve, "equity", ["symbol"], "t0"), "sharpe", "sharpe_annualized", keys=("symbol", "n_periods"))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES} SELECT symbol, round(CASE WHEN count(*) FILTER (pnl <> 0) >= 2 AND stddev_pop(pnl) FILTER (pnl <> 0) > 0
  THEN avg(pnl) FILTER (pnl <> 0) / (stddev_pop(pnl) FILTER (pnl <> 0) + 1e-12) ELSE 0 END, 6) + 0 AS sharpe FROM trd GROUP BY symbol""")
def per_trade_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    return shown(metrics.per_trade_sharpe(backtest.independent(scored(spark, folder), RULES), "pnl", ["symbol"]), "sharpe", keys=("symbol",))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, fl AS (SELECT symbol, t1 AS x, 0 AS kind, -size AS d FROM tr0 WHERE size > 0 UNION ALL SELECT symbol, t0, 1, size FROM tr0 WHERE size > 0),
fs AS (SELECT symbol, x, kind, sum(d) AS d FROM fl GROUP BY ALL)
SELECT symbol, round(max(o), 6) + 0 AS peak FROM (SELECT symbol, sum(d) OVER (PARTITION BY symbol ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS o FROM fs) GROUP BY symbol""")
def peak_gross_exposure(spark: SparkSession, folder: str) -> DataFrame:
    trades = backtest.independent(scored(spark, folder), RULES).filter("size > 0")
    return shown(metrics.peak_exposure(trades), "peak", keys=("symbol",))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, pl AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, t0, equity FROM eq)
SELECT symbol, t0, round(equity, 6) + 0 AS equity FROM pl WHERE i % greatest(n // 18, 1) = 0 OR i = n - 1""")
def curve_downsample(spark: SparkSession, folder: str) -> DataFrame:
    """Every (n / 18)-th point of the equity curve and the last, for a chart."""
    w = Window.partitionBy("symbol")
    curve = backtest.independent(scored(spark, folder), RULES).withColumns({
        "i": F.row_number().over(w.orderBy("t0")) - 1, "n": F.count(F.lit(1)).over(w),
    })
    chosen = curve.filter((F.pmod("i", F.greatest(F.floor(F.col("n") / 18), F.lit(1))) == 0) | (F.col("i") == F.col("n") - 1))
    return shown(chosen, "equity", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, x AS (SELECT pnl, count(*) OVER () AS n, avg(pnl) OVER () AS m FROM trd WHERE size > 0)
SELECT count(*) AS n, round(skewness(pnl), 5) + 0 AS skew, round(kurtosis(pnl) + 3, 5) + 0 AS kurt FROM x""")
def pnl_moments(spark: SparkSession, folder: str) -> DataFrame:
    trades = backtest.independent(scored(spark, folder), RULES).filter("size > 0").withColumn("all", F.lit(0))
    out = metrics.sample_moments(trades, "pnl", ["all"])
    return out.select("n", rounded(F.col("skew"), 5).alias("skew"), rounded(F.col("kurt"), 5).alias("kurt"))


_LUCK = repr(metrics.expected_maximum(50))
_T = "(1 / (1 + 0.2316419::DOUBLE * abs(z)))"
_TAIL = f"exp(-z * z / 2) / 2.5066282746310002::DOUBLE * {_T} * (0.319381530::DOUBLE + {_T} * (-0.356563782::DOUBLE + {_T} * (1.781477937::DOUBLE + {_T} * (-1.821255978::DOUBLE + {_T} * 1.330274429::DOUBLE))))"


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, s AS (SELECT symbol, count(*) AS n, avg(pnl) / (stddev_pop(pnl) + 1e-12) AS sr, skewness(pnl) AS g1, kurtosis(pnl) + 3 AS g2 FROM trd WHERE pnl <> 0 GROUP BY symbol),
v AS (SELECT *, sqrt(greatest((1 - g1 * sr + (g2 - 1) / 4 * sr * sr) / (n - 1), 0)) AS dev FROM s), zz AS (SELECT *, (sr - {_LUCK} * dev) / (dev + 1e-12) AS z FROM v)
SELECT symbol, n, round(sr, 6) + 0 AS sharpe, round(g1, 5) + 0 AS skew, round(g2, 5) + 0 AS kurt, round(CASE WHEN z >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END, 6) + 0 AS probability FROM zz""")
def deflated_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ratio, moments of the gains, and the probability that the ratio is above what the best of 50 trials shows by luck."""
    trades = backtest.independent(scored(spark, folder), RULES).filter("pnl <> 0")
    df = metrics.per_trade_sharpe(trades, "pnl", ["symbol"]).join(metrics.sample_moments(trades, "pnl", ["symbol"]), "symbol")
    df = df.withColumn("probability", metrics.deflated_sharpe(F.col("sharpe"), 50, F.col("n"), F.col("skew"), F.col("kurt")))
    return df.select("symbol", "n", rounded(F.col("sharpe")).alias("sharpe"), rounded(F.col("skew"), 5).alias("skew"), rounded(F.col("kurt"), 5).alias("kurt"), rounded(F.col("probability")).alias("probability"))


@query(f"""WITH {sql.EVENTS}, pf AS (SELECT (r0 % 7)::INT AS config, (dayofyear(t0) % 8)::INT AS split, avg(ret) AS value FROM labels_all GROUP BY ALL),
ma AS (SELECT mask FROM range(256) t(mask) WHERE bit_count(mask::INT) = 4),
me AS (SELECT mask, config, avg(value) FILTER ((mask >> split) & 1 = 1) AS i, avg(value) FILTER ((mask >> split) & 1 = 0) AS o FROM pf, ma GROUP BY ALL),
be AS (SELECT mask, arg_max(o, (i, -config)) AS best FROM me GROUP BY mask),
rk AS (SELECT mask, least(greatest(avg((o <= best)::INT), 1e-6), 1 - 1e-6) AS r FROM me JOIN be USING (mask) GROUP BY mask)
SELECT round(avg((ln(r / (1 - r)) <= 0)::INT), 6) + 0 AS pbo FROM rk""")
def pbo(spark: SparkSession, folder: str) -> DataFrame:
    bars = panel(spark, folder).withColumn("rn", F.row_number().over(series()))
    events = labels.first_touch(bars).join(bars.select("symbol", F.col("ts").alias("t0"), "rn"), ["symbol", "t0"])
    perf = events.groupBy(F.pmod("rn", F.lit(7)).cast("int").alias("config"), F.pmod(F.dayofyear("t0"), F.lit(8)).cast("int").alias("split")).agg(F.avg("ret").alias("value"))
    return metrics.overfitting_probability(perf, 8).select(rounded(F.col("pbo")).alias("pbo"))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {_TRADES}, {GROUPS.format(n=6)}, pairs AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS combo FROM range(6) x(a), range(6) y(b) WHERE a < b),
cs AS (SELECT p.symbol, combo, CASE WHEN count(*) FILTER (p.pnl <> 0) >= 2 AND stddev_pop(p.pnl) FILTER (p.pnl <> 0) > 0
  THEN avg(p.pnl) FILTER (p.pnl <> 0) / (stddev_pop(p.pnl) FILTER (p.pnl <> 0) + 1e-12) ELSE 0 END AS sr FROM trd p JOIN gr g ON g.symbol = p.symbol AND g.t0 = p.t0 JOIN pairs ON g.grp = a OR g.grp = b GROUP BY ALL)
SELECT symbol, count(*) AS n_combos, round(avg(sr), 6) + 0 AS mean_sharpe, round(stddev_pop(sr), 6) + 0 AS std_sharpe FROM cs GROUP BY symbol""")
def cpcv_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per-trade ratio of each combination's test events, and its mean and deviation over combinations."""
    events = scored(spark, folder)
    test = validation.combinatorial_folds(events, 6, 2, 0.02).filter("part = 'test'").select("symbol", "combo", "t0")
    ratios = metrics.per_trade_sharpe(backtest.independent(events, RULES).join(test, ["symbol", "t0"]), "pnl", ["symbol", "combo"])
    out = ratios.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_combos"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"))
    return shown(out, "mean_sharpe", "std_sharpe", keys=("symbol", "n_combos"))


@query()
def audit(spark: SparkSession, folder: str) -> DataFrame:
    """Integrity checks of labels, folds, ledger and features."""
    return checks.audit(panel(spark, folder), scored(spark, folder), RULES)


@query()
def portfolio_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.portfolio(scored(spark, folder), panel(spark, folder), RULES)


@query()
def portfolio_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """End equity and drawdowns of the marked curve per symbol."""
    points = backtest.portfolio(scored(spark, folder), panel(spark, folder), RULES, "points")
    down = metrics.drawdowns(points, "marked", ["symbol"], ["ts", "seq"])
    return points.groupBy("symbol").agg(F.max_by("equity", F.when(F.col("equity").isNotNull(), F.struct("ts", "seq"))).alias("end_equity")).join(down, "symbol")


def learning_features(bars: DataFrame) -> DataFrame:
    """A panel of bars with the features of the learners."""
    return bars.withColumns({"mom_24": momentum(F.col("close"), 24), "atr_norm": F.col("atr_14") / (F.col("close") + metrics.EPS)})


def labelled_features(bars: DataFrame) -> DataFrame:
    """Labels of bars (a panel with the learners' features), with the features and the weight that learners are fitted on."""
    found = labels.first_touch(bars).join(bars.select("symbol", F.col("ts").alias("t0"), "mom_24", "atr_norm"), ["symbol", "t0"])
    return labels.combined_weights(labels.uniqueness(bars, found.filter("mom_24 is not null and atr_norm is not null")))


def learning_events(spark: SparkSession, folder: str) -> DataFrame:
    return stored(labelled_features(stored(learning_features(panel(spark, folder)))))


FEATURES = ["atr_norm", "mom_24", "side"]


@query()
def stacking_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-fitted stack of the experts' out-of-fold probabilities."""
    return learning.stack(learning.out_of_fold(learning_events(spark, folder), FEATURES))


@query()
def expert_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Which experts the meta model may read, by their AUC on the earlier half."""
    return learning.select_experts(learning.out_of_fold(learning_events(spark, folder), FEATURES))


@query()
def model_signals(spark: SparkSession, folder: str) -> DataFrame:
    """From model to decision: out-of-fold experts, selection, stack, joint calibration and conformal flags, signals."""
    events = learning_events(spark, folder)
    oof = learning.out_of_fold(events, FEATURES)
    kept = learning.select_experts(oof).filter("kept").select("expert")
    fitted = calibration.cross_fit(learning.stack(oof.join(F.broadcast(kept), "expert")))  # a row per expert
    df = fitted.select("symbol", "t0", F.col("calibrated").alias("prob"), "confident", "tag").join(events, ["symbol", "t0"]).filter("prob is not null")
    columns = backtest.decide(F.col("prob"), F.col("side"), F.col("close"), F.col("trgt") * F.col("close"), F.col("confident"), RULES)
    return df.withColumns({k: v for k, v in columns.items() if k != "atr"}).select("symbol", "t0", "bin", "prob", "confident", "tag", *[k for k in columns if k != "atr"])


@query()
def cpcv_refit(spark: SparkSession, folder: str) -> DataFrame:
    """Per-trade ratio of each combination's test events, scored by an expert fitted on its train rows."""
    events = learning_events(spark, folder)
    probs = learning.refit_combinations(events, FEATURES).withColumn("confident", F.lit(True))
    rows = probs.join(events.select("symbol", "t0", "t1", "ret", "bin", "bars_held"), ["symbol", "t0"])
    return backtest.combination_ratios(rows, RULES)


@query()
def stored_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Everything fitted on the earlier 70 % of each symbol's labels and stored; the later events are scored from the stored version."""
    events = stored(learning_events(spark, folder).withColumn("late", learning.early_late(0.3)))
    bound = events.filter("late").groupBy("symbol").agg(F.min("t0").alias("bound"))
    early = events.join(bound, "symbol").filter("not late and t1 < bound")  # no label that ends among the scored events
    models = shared_folder(spark)
    lifecycle.save(lifecycle.fit(early, FEATURES), models, "v0")
    rows = events.filter("late").select("symbol", "t0", "bin", *FEATURES)
    return lifecycle.score(lifecycle.load(spark, models), rows).select("symbol", "t0", "bin", "prob", "confident", "tag", "version")


@query()
def fusion_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold probabilities of the head over series scores and features."""
    scores = learning.naive_scores(source.hourly(spark, folder)).select("symbol", F.col("ts").alias("t0"), "score")
    events = learning_events(spark, folder).join(scores, ["symbol", "t0"])
    oof = learning.out_of_fold(events, [*FEATURES, "score"], experts={"fusion": learning.fusion_head})
    return oof.select("symbol", "t0", "expert", "fold", "prob", "bin")


_PERMUTED = f"""ev0 AS (SELECT * FROM labels_all), sd AS (SELECT unnest(range(9)) AS seed),
pl AS (SELECT ev0.*, seed, row_number() OVER (PARTITION BY symbol, seed ORDER BY t0) AS i,
  CASE WHEN seed = 0 THEN row_number() OVER (PARTITION BY symbol, seed ORDER BY t0)
    ELSE row_number() OVER (PARTITION BY symbol, seed ORDER BY md5(seed || '|' || epoch_us(t0))) END AS j FROM ev0, sd),
ev AS (SELECT a.symbol || '|' || a.seed AS symbol, a.seed, a.t0, a.t1, a.side, b.bin FROM pl a JOIN pl b ON a.symbol = b.symbol AND a.seed = b.seed AND a.i = b.j),
{sql.PROBS}, ra AS (SELECT seed, bin, rank() OVER (PARTITION BY seed ORDER BY prob) + (count(*) OVER (PARTITION BY seed, prob) - 1) / 2.0::DOUBLE AS r FROM pe)"""


@query(f"""WITH {sql.LABELS}, {_PERMUTED} SELECT seed::INT AS seed, count(*) AS n,
  round((sum(r) FILTER (bin = 1) - sum(bin) * (sum(bin) + 1) / 2.0::DOUBLE) / (sum(bin) * (count(*) - sum(bin))), 6) + 0 AS auc FROM ra GROUP BY seed""")
def permutation_auc(spark: SparkSession, folder: str) -> DataFrame:
    """What the hit-rate expert makes of labels dealt anew, a row per seed: it must see nothing in them. Seed 0 has the labels as they are."""
    rows = learning.hit_rate(learning.permuted(all_labels(spark, folder), 8))
    counts = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return shown(metrics.auc(rows, "prob", "bin", ["seed"]).join(counts, "seed"), "auc", keys=("seed", "n"))


#: Learners of the nested evaluation: refitted in every inner fold of every combination.
NESTED = {
    "logistic": learning.EXPERTS["logistic"],
    "stump": lambda: GBTClassifier(labelCol="bin", weightCol="w", maxIter=2, maxDepth=1, seed=42),
}
GROUPS_N, GROUPS_K = 4, 2


def evaluated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Each combination's ratio per configuration with what its calibration rests on, and the trades behind them."""
    events = learning_events(spark, folder)
    judged, said = learning.evaluate_combinations(events, FEATURES, GROUPS_N, GROUPS_K, experts=NESTED)
    rows = stored(judged.join(events.select("symbol", "t0", "t1", "ret", "bin", "bars_held"), ["symbol", "t0"]))
    return stored(backtest.combination_ratios(rows, RULES).join(said, ["symbol", "combo", "expert"])), rows


@query()
def cpcv_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Nested out-of-fold fits in each combination, each with its own calibrator and conformal quantile, and its back-test."""
    out, _ = evaluated(spark, folder)
    return out.select("symbol", "combo", "expert", "n_trades", "sharpe", "n_oof", "n_fit", "n_conformal", "qhat", "tag")


@query()
def cpcv_report(spark: SparkSession, folder: str) -> DataFrame:
    """The nested evaluation rolled up per symbol, with what must be said of it."""
    out, rows = evaluated(spark, folder)
    names = [*sorted(NESTED), "ensemble"]
    n_combos = len(validation.combinations(GROUPS_N, GROUPS_K))
    perf = out.select("symbol", F.array_position(F.array(*map(F.lit, names)), F.col("expert")).cast("int").alias("config"), F.col("combo").alias("split"), F.col("sharpe").alias("value"))
    own = rows.filter("expert = 'ensemble'").withColumn("symbol", F.concat_ws("|", "symbol", F.col("combo").cast("string")))
    pnl = backtest.independent(own, RULES).filter("size > 0").select(F.split_part("symbol", F.lit("|"), F.lit(1)).alias("symbol"), "pnl")
    moments = metrics.sample_moments(pnl, "pnl", ["symbol"]).select("symbol", "skew", "kurt")
    total = out.groupBy("symbol").agg(
        F.count(F.when(F.col("expert") == "ensemble", 1)).alias("n_combos"), F.countDistinct("expert").alias("n_configs"),
        F.avg(F.when(F.col("expert") == "ensemble", F.col("sharpe"))).alias("mean_sharpe"),
        F.stddev_pop(F.when(F.col("expert") == "ensemble", F.col("sharpe"))).alias("std_sharpe"),
        F.greatest(F.floor(F.avg(F.when(F.col("expert") == "ensemble", F.col("n_trades")))), F.lit(2)).alias("n_obs"),
        F.sort_array(F.collect_set("tag")).alias("degradations"),
    )
    each = out.groupBy("symbol", "expert").agg(F.avg("sharpe").alias("m")).groupBy("symbol").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("expert", "m")))).alias("config_means")
    )
    df = total.join(each, "symbol").join(moments, "symbol", "left").join(metrics.overfitting_probability(perf, n_combos, ("symbol",)), "symbol", "left")
    luck = metrics.deflated_sharpe(F.col("mean_sharpe"), 50, F.col("n_obs"), F.coalesce("skew", F.lit(0.0)), F.coalesce("kurt", F.lit(3.0)))
    caveats = F.array_compact(F.array(
        F.lit(f"units are combinations, not paths: {validation.paths(GROUPS_N, GROUPS_K)} paths could be made of them"),
        F.lit("combinations share data, so their spread is too small"),
        F.when(F.col("n_configs") < 8, F.concat(F.lit("overfitting is judged on "), F.col("n_configs").cast("string"), F.lit(" configurations only"))),
        F.when(F.size("degradations") > 0, F.concat(F.lit("calibration: "), F.concat_ws("; ", "degradations"))),
    ))
    return df.withColumns({"deflated_sharpe": luck, "caveats": caveats, "pbo_warning": F.col("n_configs") < 8}).select(
        "symbol", "n_combos", "n_configs", "mean_sharpe", "std_sharpe", "n_obs", "deflated_sharpe", "pbo", "pbo_warning", "config_means", "degradations", "caveats"
    )


_POINTS = """ro AS (SELECT symbol, fold, part, t0, bin, round(prob * 100)::INT AS point FROM dl),
ct AS (SELECT symbol, fold, point, count(*) AS n, sum(bin) AS pos FROM ro WHERE part = 'train' GROUP BY ALL),
sm AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM ct WINDOW w AS (PARTITION BY symbol, fold ORDER BY point ROWS UNBOUNDED PRECEDING)),
mn AS (SELECT a.symbol, a.fold, a.point AS a, b.point AS b, (b.cp - (a.cp - a.pos))::DOUBLE / (b.cn - (a.cn - a.n)) AS mean FROM sm a JOIN sm b ON a.symbol = b.symbol AND a.fold = b.fold AND a.point <= b.point),
ls AS (SELECT x.symbol, x.fold, x.a, y.b AS "at", min(x.mean) AS least FROM mn x JOIN mn y ON x.symbol = y.symbol AND x.fold = y.fold AND x.a = y.a AND x.b >= y.b GROUP BY ALL),
fi AS (SELECT symbol, fold, "at" AS point, max(least) AS value FROM ls GROUP BY ALL),
sd AS (SELECT r.symbol, r.fold, r.point, max(f.point) FILTER (f.point <= r.point) AS x0, min(f.point) FILTER (f.point >= r.point) AS x1,
  arg_max(f.value, f.point) FILTER (f.point <= r.point) AS v0, arg_min(f.value, f.point) FILTER (f.point >= r.point) AS v1
  FROM (SELECT DISTINCT symbol, fold, point FROM ro) r JOIN fi f ON f.symbol = r.symbol AND f.fold = r.fold GROUP BY ALL),
cv AS (SELECT symbol, fold, point, coalesce(v0 + coalesce((point - x0)::DOUBLE / nullif(x1 - x0, 0), 0) * (v1 - v0), v0, v1) AS calibrated FROM sd),
fd AS (SELECT ro.*, calibrated FROM ro JOIN cv USING (symbol, fold, point)),
sc AS (SELECT symbol, fold, list_sort(list(CASE WHEN bin = 1 THEN 1 - calibrated ELSE calibrated END)) AS s, count(*) AS n FROM fd WHERE part = 'train' GROUP BY ALL HAVING count(*) >= 10 AND min(bin) < max(bin)),
lv AS (SELECT *, least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1) * (n - 1) AS "at" FROM sc),
qt AS (SELECT symbol, fold, s[floor("at")::INT + 1] + ("at" - floor("at")) * (s[ceil("at")::INT + 1] - s[floor("at")::INT + 1]) AS qhat FROM lv)"""


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, {GROUPS.format(n=5).replace("0.02", "0.01")}, dl AS (SELECT jd.symbol, jd.fold, CASE WHEN test THEN 'test' ELSE 'train' END AS part, jd.t0, pe.bin, pe.prob
  FROM jd JOIN pe ON pe.symbol = jd.symbol AND pe.t0 = jd.t0 WHERE test OR NOT (pur OR emb)), {_POINTS}
SELECT fd.symbol, t0, fd.fold::INT AS fold, round(calibrated, 6) + 0 AS calibrated, coalesce((1 - calibrated <= round(qhat, 9)) <> (calibrated <= round(qhat, 9)), true) AS confident
FROM fd LEFT JOIN qt ON qt.symbol = fd.symbol AND qt.fold = fd.fold WHERE part = 'test'""")
def cross_fitted_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated probability and conformal flag of each event, both fitted on other folds."""
    return shown(calibration.cross_fit(scored(spark, folder)), "calibrated", keys=("symbol", "t0", "fold", "confident"))


@query(f"""WITH {sql.EVENTS}, {sql.PROBS}, od AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t0) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM pe),
dl AS (SELECT symbol, 0 AS fold, t0, bin, prob, CASE WHEN n < 40 OR i <= n - greatest(floor(n * 0.3::DOUBLE), 20) THEN 'train' ELSE 'late' END AS part FROM od), {_POINTS.replace("WHERE part = 'train' GROUP BY ALL HAVING", "WHERE part = 'late' GROUP BY ALL HAVING")}
SELECT symbol, count(*) AS n, count(*) FILTER (part = 'train') AS n_fit, round(any_value(qhat), 6) + 0 AS qhat FROM dl LEFT JOIN qt USING (symbol) GROUP BY symbol""")
def deploy_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """What scores rows to come: calibrator on the earlier events, conformal quantile on the later ones."""
    return shown(calibration.deploy_fit(scored(spark, folder))[1], "qhat", keys=("symbol", "n", "n_fit"))


@query(f"""{_CUSUM}, {sql.LABELLED}, ev AS (SELECT * FROM labels_all), {sql.PROBS.split("pe AS")[0].rstrip().rstrip(",")}, n AS (SELECT symbol, count(*) FILTER (hit) AS n_hits FROM c GROUP BY symbol),
la AS (SELECT * FROM sided WHERE side IS NOT NULL AND trgt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
lb AS (SELECT la.*, c.hit OR n_hits < 50 AS event FROM la JOIN c ON c.symbol = la.symbol AND c.rn = la.rn JOIN n ON n.symbol = la.symbol),
pd AS (SELECT lb.*, round((coalesce(el.wins, 0) + 1) / (coalesce(el.n, 0) + 2), 4) AS prob, coalesce(el.n, 0) = 20 AS confident, trgt * close AS unit FROM lb ASOF LEFT JOIN el ON el.symbol = lb.symbol AND el.side = lb.side AND lb.ts >= el.t1),
d AS (SELECT *, {_SIZE} AS size FROM pd),
r AS (SELECT *, CASE WHEN NOT event THEN 'not_cusum_event' WHEN NOT confident THEN 'low_confidence_conformal' WHEN side = 0 THEN 'no_side' WHEN prob < 0.55::DOUBLE THEN 'prob_below_threshold' WHEN size <= 0 THEN 'kelly_non_positive_after_cost' END AS reason FROM d)
SELECT symbol, ts, CASE WHEN reason IS NOT NULL THEN 'HOLD' WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS signal, CASE WHEN event THEN round(prob, 4) END AS win_probability,
  CASE WHEN reason IS NOT NULL THEN 0 ELSE round(size, 4) END AS suggested_position_pct, CASE WHEN reason IS NULL THEN round(close - side * 1.5::DOUBLE * unit, 2) + 0 END AS stop_loss,
  CASE WHEN reason IS NULL THEN round(close + side * 1.5::DOUBLE * unit, 2) + 0 END AS take_profit, reason FROM r""")
def latest_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decision on each symbol's last complete bar; a bar that is no sampled event is held."""
    bars = stored(labels.cusum_threshold(panel(spark, folder)))
    complete = bars.filter("side is not null and trgt is not null")
    last = source.keep_first(complete, ["symbol"], [F.desc("ts")])
    times = labels.event_times(bars, F.col("threshold"), min_events=50)
    df = learning.hit_rate(last, at="ts", history=labels.first_touch(bars))
    df = df.join(times.select("symbol", "ts", F.lit(True).alias("event")), ["symbol", "ts"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
    columns = backtest.decide(F.col("prob"), F.col("side"), F.col("close"), F.col("trgt") * F.col("close"), F.col("confident"), RULES)
    columns = backtest.hold_unless(columns, F.col("event"), "not_cusum_event")
    names = ("signal", "win_probability", "suggested_position_pct", "stop_loss", "take_profit", "reason")
    return df.select("symbol", "ts", *[(columns[c] + F.lit(0.0) if c in ("stop_loss", "take_profit") else columns[c]).alias(c) for c in names])


@query(f"""WITH {sql.BARS} SELECT symbol, max(ts) AS ts, 'HOLD' AS signal, 'feature_schema_mismatch' AS reason, 'feature_schema_mismatch(news_sentiment,tf4h_trend)' AS tag, 0::DOUBLE AS suggested_position_pct, 2 AS n_missing FROM bars GROUP BY symbol""")
def schema_mismatch_holds(spark: SparkSession, folder: str) -> DataFrame:
    """Holds where the last bars lack features that the model was fitted with."""
    bars, missing = features.align_schema(source.hourly(spark, folder), ["close", "news_sentiment", "tf4h_trend"])
    rows = backtest.hold_for_schema(source.keep_first(bars, ["symbol"], [F.desc("ts")]), missing)
    return rows.select("symbol", "ts", "signal", "reason", "tag", "suggested_position_pct", F.size("missing").alias("n_missing"))


@query()
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the later events, calibrated on the earlier ones."""
    df = scored(spark, folder).withColumn("late", learning.early_late(0.3))
    return learning.calibrate(df.filter("not late"), df.filter("late")).select("symbol", "t0", "prob", "calibrated")
