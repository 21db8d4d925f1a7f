"""Experts, out-of-fold probabilities, stacking and calibration with Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions import windows as W
from barflow.operators import calibration, metrics, validation
from barflow.operators.asof import asof
from barflow.operators.crossfit import WHOLE, cross_fit_meta, deal, fit_units, series_key, vectors
from barflow.stored import stored


EXPERTS = {
    "gbdt": lambda: GBTClassifier(labelCol="bin", weightCol="w", maxIter=5, maxDepth=3, seed=42),
    "logistic": lambda: LogisticRegression(labelCol="bin", weightCol="w", regParam=0.01),
}


def fusion_head():  # noqa: ANN201
    """A logistic head over series scores and features brought to one scale; scale and head are fitted on train rows only."""
    scale = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)
    return Pipeline(stages=[scale, LogisticRegression(labelCol="bin", weightCol="w", featuresCol="_scaled", regParam=0.05)])


def ended_hits(events: DataFrame, last: int = 20) -> DataFrame:
    """(symbol, side, _key, t1, wins, n): wins among the last labels of a symbol and side that had ended at t1, itself included."""
    w = Window.partitionBy("symbol", "side").orderBy("t1", "t0").rowsBetween(-(last - 1), 0)
    ended = events.select("symbol", "side", "t0", "t1", F.sum("bin").over(w).alias("wins"), F.count(F.lit(1)).over(w).alias("n"))
    one = ended.groupBy("symbol", "side", "t1").agg(F.max_by(F.struct("wins", "n"), "t0").alias("h"))
    return one.select("symbol", "side", _key(), "t1", "h.wins", "h.n")


def _key() -> Column:
    return F.concat_ws("|", "symbol", F.col("side").cast("string")).alias("_key")


def hit_rate(events: DataFrame, last: int = 20, at: str = "t0", history: DataFrame | None = None) -> DataFrame:
    """events with ``prob`` and ``confident``: the expert that expects the wins of late to go on.

    The probability is the smoothed share of wins among the last labels of the same symbol
    and side that had ended by ``at``; without ``last`` of them it is not confident. The
    event's own label is never among them. ``history``, if given, has the labels.
    """
    ended = ended_hits(events if history is None else history, last)
    df = asof(events.withColumn("_key", _key()), ended, F.col(at), F.col("t1"), ["wins", "n"], by="_key", prefix="_")
    wins, n = F.coalesce("_wins", F.lit(0)), F.coalesce("_n", F.lit(0))
    prob = F.round((wins + 1) / (n + 2), 4)
    return df.withColumns({"prob": prob, "confident": n == last}).select(*[c for c in events.columns if c not in ("prob", "confident")], "prob", "confident")


def naive_scores(bars: DataFrame, horizon: int = 24) -> DataFrame:
    """(symbol, ts, score): mean of the last 23 log returns times the horizon, over the volatility of the last 63."""
    lr = F.ln(F.col("close") + 1e-9) - F.lag(F.ln(F.col("close") + 1e-9)).over(W.series())
    df = bars.withColumn("_lr", lr)
    near, far = W.series().rowsBetween(-22, 0), W.series().rowsBetween(-62, 0)
    enough = F.count(F.lit(1)).over(W.series().rowsBetween(Window.unboundedPreceding, 0)) >= 8
    score = F.avg("_lr").over(near) * horizon / ((F.stddev_pop("_lr").over(far) + 1e-6) * F.sqrt(F.lit(float(horizon))))
    return df.select("symbol", "ts", F.when(enough, score).otherwise(0.0).alias("score"))


def one_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    """Events with their features as a vector, all train rows of one combination."""
    rows = vectors(df, columns).select("symbol", "t0", "t1", "bin", "w", "features")
    return rows.withColumns({"combo": F.lit(0), "outer": F.lit("train")})


def made(experts: dict | None) -> dict:
    return {name: (lambda _, make=make: make()) for name, make in (experts or EXPERTS).items()}


def out_of_fold(df: DataFrame, columns: list[str], n_folds: int = 3, experts: dict | None = None, embargo: float = 0.01) -> DataFrame:
    """(symbol, t0, t1, expert, fold, prob, bin, w): each expert's probability for events it was not fitted on.

    Folds are contiguous in time; rows whose labels meet the test fold, and those of the embargo
    after it, are not learned from. The fits run side by side; the driver holds models only.
    """
    dealt = deal(one_combination(df, columns), n_folds, embargo).filter(F.col("fold") != WHOLE)
    scored, _ = fit_units(dealt, made(experts))
    return scored.select("symbol", "t0", "t1", "expert", "fold", "prob", "bin", "w")


def select_experts(oof: DataFrame, min_auc: float = 0.5, pseudo: tuple[str, ...] = (), min_rows: int = 20) -> DataFrame:
    """(expert, auc, kept, reason): which experts the meta model may read. A row per expert.

    Experts that were not refitted in the folds (``pseudo``) never enter. Weak ones are
    told by their AUC on the earlier half of each symbol's events, so that the later half
    stays fit for reports; fewer than ``min_rows`` events are all judged. If all are weak,
    the best one stays. An expert without an AUC (one class only) is kept.
    """
    w = Window.partitionBy("symbol", "expert")
    placed = oof.withColumns({"_i": F.row_number().over(w.orderBy("t0")), "_n": F.count(F.lit(1)).over(w)})
    early = placed.filter((F.col("_n") < min_rows) | (F.col("_i") <= F.greatest(F.floor(F.col("_n") / 2), F.lit(10))))
    scores = metrics.auc(early, "prob", "bin", ["expert"])
    false = F.lit(False)
    is_pseudo = F.coalesce(F.col("expert").isin(*pseudo), false) if pseudo else false
    weak = F.coalesce(F.col("auc") < min_auc, false)
    usable = Window.partitionBy(is_pseudo)  # a handful of experts
    all_weak = F.min(weak.cast("int")).over(usable) == 1
    best = F.row_number().over(usable.orderBy(F.desc("auc"), "expert")) == 1
    reason = F.when(is_pseudo, "not_refitted_in_folds").when(weak & ~(all_weak & best), "low_auc").when(weak, "best_of_weak_experts")
    return scores.select("expert", "auc", (~is_pseudo & (~weak | (all_weak & best))).alias("kept"), reason.alias("reason"))


def meta_learner(c: float = 1.0):  # noqa: ANN201
    """A logistic meta model whose penalty is that of ``c`` for the sum of the weights."""
    return lambda unit: LogisticRegression(labelCol="bin", weightCol="w", regParam=1 / (c * (unit["w"] or 1.0)), standardization=False)


def stack(oof: DataFrame, c: float = 1.0, n_folds: int = 3, embargo: float = 0.01) -> DataFrame:
    """(symbol, t0, t1, bin, prob, fallback): a logistic meta model over the experts' probabilities, cross-fitted.

    Its folds are purged by label intervals and embargoed, as the experts' are. With fewer
    than two rows a fold the meta model is fitted and applied on the same rows, and
    ``fallback`` says so.
    """
    names = [r[0] for r in oof.select("expert").distinct().orderBy("expert").collect()]  # one row per expert
    scored, _ = cross_fit_meta(oof.withColumn("combo", F.lit(0)), names, meta_learner(c), n_folds, embargo)
    return scored.filter(F.col("fold") != WHOLE).select("symbol", "t0", "t1", "bin", "prob", "fallback")


def combination_rows(df: DataFrame, columns: list[str], n: int, k: int, embargo: float) -> DataFrame:
    """Each event once per combination as outer train or test row; purged and embargoed ones are in neither."""
    parts = validation.combinatorial_folds(df, n, k, embargo).filter("part <> 'out'").withColumnRenamed("part", "outer")
    return vectors(df, columns).select("symbol", "t0", "t1", "bin", "w", "features").join(parts, ["symbol", "t0"])


def refit_combinations(df: DataFrame, columns: list[str], n: int = 6, k: int = 2, embargo: float = 0.02, experts: dict | None = None) -> DataFrame:
    """(symbol, combo, expert, t0, prob): test probabilities of experts fitted anew on the train rows of each combination."""
    rows = combination_rows(stored(df), columns, n, k, embargo)
    whole = rows.withColumns({"fold": F.lit(WHOLE), "part": F.col("outer"), "fallback": F.lit(False)}).drop("outer")
    scored, _ = fit_units(whole, made(experts or {"logistic": EXPERTS["logistic"]}))
    return scored.select("symbol", "combo", "expert", "t0", "prob")


def evaluate_combinations(
    df: DataFrame, columns: list[str], n: int = 6, k: int = 2, embargo: float = 0.01, inner: int = 3, experts: dict | None = None,
    alpha: float = 0.1, late_share: float = 0.3, parallel: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Test probabilities of every combination as deployment would give them, and what their calibrators were fitted on.

    Within the train rows of a combination, each expert gets out-of-fold probabilities on
    purged inner folds and a fit on all of them; a meta model over these is cross-fitted
    likewise. The calibrator of a combination and configuration (each expert, and ``ensemble``) is fitted on the earlier
    of its out-of-fold rows, the conformal quantile on the later ones; the
    test rows get both. Returns (symbol, combo, expert, t0, prob, confident) and (symbol, combo,
    expert, n_oof, n_fit, n_conformal, qhat, tag). With under 20 out-of-fold rows or one class
    among them, probabilities stay raw and confident, and the tag says so.
    """
    learners = made(experts)
    dealt = deal(combination_rows(stored(df), columns, n, k, embargo), inner, embargo)
    scored, _ = fit_units(dealt, learners, parallel)
    meta, _ = cross_fit_meta(scored, sorted(learners), meta_learner(), inner, embargo, parallel)
    all_rows = stored(scored.unionByName(meta).withColumn("_key", series_key("symbol", "combo", "expert")))
    keys = all_rows.select("_key", "symbol", "combo", "expert").distinct()
    oof = all_rows.filter(F.col("fold") != WHOLE).select(F.col("_key").alias("symbol"), "t0", "t1", "bin", "prob", "fallback")
    sizes = oof.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_oof"), F.countDistinct("bin").alias("classes"), F.max("fallback").alias("fallback"))
    enough = sizes.filter((F.col("n_oof") >= calibration.MIN_CONFORMAL_ROWS) & (F.col("classes") == 2)).select("symbol")
    fit, quantiles = calibration.deploy_fit(oof.join(enough, "symbol", "left_semi"), "prob", late_share, alpha)
    quantiles = stored(quantiles)
    test = all_rows.filter(F.col("fold") == WHOLE).select(F.col("_key").alias("symbol"), "t0", "prob")
    judged = calibration.apply_fit(test, fit, "prob", ["symbol"]).join(quantiles.select("symbol", "qhat"), "symbol", "left")
    flag = metrics.conformal_flags(F.col("calibrated"), F.col("qhat"))["confident"]
    judged = judged.select(F.col("symbol").alias("_key"), "t0", F.coalesce("calibrated", "prob").alias("prob"), F.coalesce(flag, F.lit(True)).alias("confident"))
    judged = judged.join(keys, "_key").select("symbol", "combo", "expert", "t0", "prob", "confident")
    skipped = F.when(F.col("qhat").isNull(), F.concat(F.lit("cpcv_cal_conformal_skipped(n_oof="), F.coalesce("n_oof", F.lit(0)).cast("string"), F.lit(")")))
    alike = F.when(F.col("fallback"), "meta_nested_oof_fallback_insample")
    said = sizes.join(quantiles, "symbol", "left").withColumnRenamed("symbol", "_key").join(keys, "_key", "right").select(
        "symbol", "combo", "expert", F.coalesce("n_oof", F.lit(0)).alias("n_oof"), F.coalesce("n_fit", F.lit(0)).alias("n_fit"),
        F.when(F.col("tag").isNotNull(), F.col("n")).otherwise(F.coalesce(F.col("n") - F.col("n_fit"), F.lit(0))).alias("n_conformal"),
        "qhat", F.nullif(F.concat_ws(";", skipped, "tag", alike), F.lit("")).alias("tag"),
    )
    return judged, said


def permuted(events: DataFrame, seeds: int) -> DataFrame:
    """events for each of ``seeds`` permutations of their labels, with ``seed``; in seed 0 labels stay.

    Labels are dealt anew within a symbol in order of a digest of seed and start. A permutation is a series of its own
    (its symbol carries the seed), so one job judges all of them.
    """
    seed = F.explode(F.sequence(F.lit(0), F.lit(seeds)))
    place = Window.partitionBy("symbol", "seed")
    digest = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.unix_micros(F.col("t0").cast("timestamp")).cast("string")))
    placed = events.withColumn("seed", seed).withColumn("_i", F.row_number().over(place.orderBy("t0")))
    placed = placed.withColumn("_j", F.when(F.col("seed") == 0, F.col("_i")).otherwise(F.row_number().over(place.orderBy(digest))))
    placed = stored(placed)
    labels = placed.select("symbol", "seed", F.col("_j").alias("_i"), F.col("bin").alias("_bin"))
    dealt = placed.drop("_j").join(labels, ["symbol", "seed", "_i"]).withColumn("bin", F.col("_bin")).drop("_bin", "_i")
    return dealt.withColumn("symbol", F.concat_ws("|", "symbol", F.col("seed").cast("string")))


def early_stop_split(train: DataFrame, cutoff: Column, val_share: float = 0.15) -> DataFrame:
    """train with ``is_val``: the last share of each symbol's rows whose labels had ended before ``cutoff``; none after it validates."""
    before = F.col("t1") < cutoff
    w = Window.partitionBy("symbol", before)
    late = F.row_number().over(w.orderBy(F.desc("t0"))) <= F.floor(F.count(F.lit(1)).over(w) * F.lit(val_share))
    return train.withColumn("is_val", before & late)


def calibrate(fit_on: DataFrame, apply_to: DataFrame, prob: str = "prob", label: str = "bin", kind: str = "isotonic") -> DataFrame:
    """``apply_to`` with ``calibrated``: isotonic, or a logistic curve (platt)."""
    if kind == "isotonic":
        model = IsotonicRegression(featuresCol=prob, labelCol=label, predictionCol="calibrated")
        return model.fit(fit_on.select(prob, F.col(label).cast("double").alias(label))).transform(apply_to)
    curve = LogisticRegression(labelCol=label, featuresCol="_x").fit(vectors(fit_on, [prob]).withColumnRenamed("features", "_x"))
    scored = curve.transform(vectors(apply_to, [prob]).withColumnRenamed("features", "_x"))
    return scored.select(*apply_to.columns, vector_to_array("probability")[1].alias("calibrated"))


def early_late(late_share: float, order: str = "t0") -> Column:
    """True for the last ``late_share`` of rows per symbol in order of time."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(order))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return rank > n - F.floor(n * late_share)
