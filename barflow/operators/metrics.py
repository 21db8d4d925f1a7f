"""Scores of probabilities, conformal sets, returns and equity curves."""

from __future__ import annotations

from math import e
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def auc(df: DataFrame, prob: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums; ties get their mean rank.

    Ranks come from counts per distinct probability, so equal probabilities are one row
    before anything is ordered.
    """
    counts = df.groupBy(*by, prob).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy(prob).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"))


def classification_report(df: DataFrame, prob: str, label: str, by: list[str]) -> DataFrame:
    """n, auc, brier, logloss, accuracy and base rate per group; rows without a probability do not count."""
    rows = df.filter(F.col(prob).isNotNull())
    p, y = F.col(prob), F.col(label)
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    rest = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.ln(inside) + (1 - y) * F.ln(1 - inside))).alias("logloss"),
        F.avg(((p > 0.5).cast("int") == y).cast("double")).alias("accuracy"), F.avg(y.cast("double")).alias("base_rate"),
    )
    return rest.join(auc(rows, prob, label, by), by)


def conformal_quantile(df: DataFrame, prob: str, label: str, by: list[str], alpha: float = 0.1) -> DataFrame:
    """(by, qhat): the corrected quantile of one less the probability of the true class, linear between values."""
    score = F.when(F.col(label) == 1, 1 - F.col(prob)).otherwise(F.col(prob))
    # Equal scores are one row before anything is ordered.
    counts = df.select(*by, score.alias("score")).filter("score is not null").groupBy(*by, "score").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*by)
    placed = counts.withColumns({"to": F.sum("k").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(w)})
    level = F.least(F.ceil((F.col("n") + 1) * F.lit(1 - alpha)) / F.col("n"), F.lit(1.0))
    placed = placed.withColumn("at", level * (F.col("n") - 1))
    value = lambda place: F.min(F.when(F.col("to") > place(F.col("at")), F.col("score")))
    low, share = value(F.floor), F.first(F.col("at") - F.floor("at"))
    return placed.groupBy(*by).agg((low + share * (value(F.ceil) - low)).alias("qhat"))


def conformal_flags(prob: Column, qhat: Column) -> dict[str, Column]:
    """Which classes a prediction set has, and whether it has exactly one."""
    one, none = (1 - prob) <= qhat, prob <= qhat
    return {"in_class1": one, "in_class0": none, "confident": one != none}


def per_trade_sharpe(df: DataFrame, pnl: str, by: list[str]) -> DataFrame:
    """Mean over population deviation of the returns that are not zero; 0 for fewer than two or no deviation."""
    x = F.when(F.col(pnl) != 0, F.col(pnl))
    out = df.groupBy(*by).agg(F.count(x).alias("k"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    return out.select(*by, F.when((F.col("k") >= 2) & (F.col("s") > 0), F.col("m") / (F.col("s") + EPS)).otherwise(0.0).alias("sharpe"))


def equity_sharpe(curve: DataFrame, equity: str, by: list[str], at: str = "ts") -> DataFrame:
    """sharpe, sharpe_annualized, n_periods of step returns; flat steps count."""
    before = F.lag(equity).over(Window.partitionBy(*by).orderBy(at))
    steps = curve.select(*by, at, ((F.col(equity) - before) / F.when(F.abs(before) > 1e-15, before)).alias("r"))
    seconds = F.unix_micros(F.max(at).cast("timestamp")) / 1e6 - F.unix_micros(F.min(at).cast("timestamp")) / 1e6
    out = steps.groupBy(*by).agg(F.count("r").alias("n_periods"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), seconds.alias("t"))
    raw = F.when((F.col("n_periods") >= 2) & (F.col("s") > 0), F.col("m") / (F.col("s") + EPS)).otherwise(0.0)
    years = F.col("t") / (86400 * 365.25)
    annual = F.when(years > 0, raw * F.sqrt(F.col("n_periods") / F.nullif(years, F.lit(0.0)))).otherwise(0.0)
    return out.select(*by, raw.alias("sharpe"), annual.alias("sharpe_annualized"), "n_periods")


def drawdowns(curve: DataFrame, equity: str, by: list[str], at: list[str]) -> DataFrame:
    """(by, max_drawdown): the least of equity over its running peak, less one."""
    peak = F.max(equity).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))
    return curve.select(*by, ((F.col(equity) - peak) / peak).alias("d")).groupBy(*by).agg(F.min("d").alias("max_drawdown"))


def time_uniqueness(events: DataFrame, by: str = "symbol") -> DataFrame:
    """Events with ``uniq``: time-weighted mean of 1 / concurrency over [t0, t1), from a sweep over both ends."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    spans = events.filter("t1 > t0").withColumns({"_a": seconds("t0"), "_b": seconds("t1")})
    ends = spans.select(by, F.explode(F.array(F.struct(F.col("_a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("_b").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.groupBy(by, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(by).orderBy("x")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"c": F.sum("d").over(whole), "len": F.coalesce(F.lead("x").over(w) - F.col("x"), F.lit(0.0))})
    share = F.when(F.col("c") > 0, F.col("len") / F.col("c")).otherwise(0.0)
    points = points.withColumn("share", share).withColumn("acc", F.sum("share").over(whole) - F.col("share"))
    left = points.select(by, F.col("x").alias("_a"), F.col("acc").alias("_s"))
    right = points.select(by, F.col("x").alias("_b"), F.col("acc").alias("_t"))
    joined = spans.join(left, [by, "_a"]).join(right, [by, "_b"])
    return joined.withColumn("uniq", (F.col("_t") - F.col("_s")) / (F.col("_b") - F.col("_a"))).select(*events.columns, "uniq")


def peak_exposure(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, peak): largest sum of open sizes, released before it is taken at one time."""
    ends = trades.select(by, F.explode(F.array(
        F.struct(F.col("t1").alias("at"), F.lit(0).alias("kind"), (-F.col("size")).alias("d")),
        F.struct(F.col("t0").alias("at"), F.lit(1).alias("kind"), F.col("size").alias("d")),
    )).alias("e"))
    flows = ends.groupBy(by, "e.at", "e.kind").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return flows.withColumn("open", F.sum("d").over(w)).groupBy(by).agg(F.max("open").alias("peak"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation, right to seven digits.

    Fixed values: Abramowitz and Stegun, Handbook of Mathematical Functions, 26.2.17.
    """
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def expected_maximum(trials: int) -> float:
    """What the best of ``trials`` ratios without skill shows by luck, in deviations."""
    normal, gamma = NormalDist(), 0.5772156649
    return (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * e))


def deflated_sharpe(sharpe: Column, trials: int, n: Column, skew: Column | float = 0.0, kurt: Column | float = 3.0) -> Column:
    """Probability that the true ratio is above what the best of ``trials`` would show by luck; null if undefined."""
    if trials < 2:
        return F.lit(None).cast("double")
    skew, kurt = (F.lit(x) if isinstance(x, float) else x for x in (skew, kurt))
    variance = F.greatest((1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
    deviation = F.sqrt(variance)
    z = (sharpe - F.lit(expected_maximum(trials)) * deviation) / (deviation + EPS)
    return F.when((n >= 2) & (deviation > 0), normal_cdf(z))


def sample_moments(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """n, bias-corrected skewness and kurtosis (3 for a normal)."""
    n = F.col("n").cast("double")
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(F.col("n") > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) + 3)
    return base.select(*by, "n", skew.alias("skew"), kurt.alias("kurt"))


def overfitting_probability(perf: DataFrame, n_splits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pbo): share of half-splits whose best configuration in sample ranks in the lower half out of sample.

    perf: (by, config int, split int, value). The combinations are a table made from the
    number of splits; ties in sample go to the least configuration.
    """
    half = n_splits // 2
    inside = F.expr("shiftright(mask, split) & 1") == 1
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << n_splits) - 1)), lambda m: F.bit_count(m) == half)
    each = perf.select(*by, "config", "split", "value", F.explode(masks).alias("mask"))
    means = each.groupBy(*by, "mask", "config").agg(F.avg(F.when(inside, F.col("value"))).alias("i"), F.avg(F.when(~inside, F.col("value"))).alias("o"))
    best = means.groupBy(*by, "mask").agg(F.max_by("o", F.struct("i", -F.col("config"))).alias("best"))
    rank = means.join(best, [*by, "mask"]).groupBy(*by, "mask").agg(F.avg((F.col("o") <= F.col("best")).cast("double")).alias("rank"))
    r = F.least(F.greatest("rank", F.lit(1e-6)), F.lit(1 - 1e-6))
    return rank.groupBy(*by).agg(F.avg((F.ln(r / (1 - r)) <= 0).cast("double")).alias("pbo"))
