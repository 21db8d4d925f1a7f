"""Calibration and conformal flags by tables of counts.

Probabilities are put on a grid of hundredths. A group (a symbol, a fold) then has at
most 101 grid points, whatever its number of events, and everything is fitted on their
counts: the isotonic fit by its max-min form, the conformal quantile by running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators import metrics, validation
from barflow.stored import stored

GRID = 100
#: Rows under which folds are not fitted at all, under which a fold's conformal part is left out, and under which deployment falls back.
MIN_FOLD_ROWS, MIN_DEPLOY_ROWS, MIN_CONFORMAL_ROWS = 10, 40, 20


def grid_point(prob: Column) -> Column:
    return F.round(prob * GRID).cast("int")


def isotonic(rows: DataFrame, prob: str, label: str, by: list[str]) -> DataFrame:
    """(by, point, value): the isotonic fit at every grid point, linear between fitted points and flat outside them.

    The fit at a point is the greatest, over starts at or before it, of the least mean up
    to an end at or after it. Pairs of grid points are at most 5151 a group.
    """
    counts = rows.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*by, grid_point(F.col(prob)).alias("point")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")
    )
    w = Window.partitionBy(*by).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    summed = stored(counts).withColumns({"_n": F.sum("n").over(w), "_p": F.sum("pos").over(w)})
    starts = summed.select(*by, F.col("point").alias("a"), (F.col("_n") - F.col("n")).alias("n0"), (F.col("_p") - F.col("pos")).alias("p0"))
    ends = summed.select(*by, F.col("point").alias("b"), F.col("_n").alias("n1"), F.col("_p").alias("p1"))
    means = starts.join(ends, by).filter("a <= b").withColumn("mean", (F.col("p1") - F.col("p0")) / (F.col("n1") - F.col("n0")))
    back = Window.partitionBy(*by, "a").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    least = means.withColumn("least", F.min("mean").over(back))
    forth = Window.partitionBy(*by, "b").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    fits = least.withColumn("value", F.max("least").over(forth)).filter("a = b").select(*by, F.col("a").alias("point"), "value")
    points = fits.select(*by).distinct().withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    placed = points.join(fits, [*by, "point"], "left").withColumn("_at", F.when(F.col("value").isNotNull(), F.col("point")))
    up = Window.partitionBy(*by).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy("point").rowsBetween(0, Window.unboundedFollowing)
    sides = placed.select(
        *by, "point", F.last("value", True).over(up).alias("v0"), F.last("_at", True).over(up).alias("x0"),
        F.first("value", True).over(down).alias("v1"), F.first("_at", True).over(down).alias("x1"),
    )
    share = (F.col("point") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    inner = F.col("v0") + F.coalesce(share, F.lit(0.0)) * (F.col("v1") - F.col("v0"))
    return sides.select(*by, "point", F.coalesce(inner, "v0", "v1").alias("value"))


def apply_fit(rows: DataFrame, fit: DataFrame, prob: str, by: list[str], out: str = "calibrated") -> DataFrame:
    """``rows`` with the fitted value at their grid point; null where the group has no fit."""
    table = fit.select(*by, F.col("point").alias("_point"), F.col("value").alias(out))
    return rows.withColumn("_point", grid_point(F.col(prob))).join(table, [*by, "_point"], "left").drop("_point")


def cross_fit(rows: DataFrame, prob: str = "prob", n_folds: int = 5, embargo: float = 0.01, alpha: float = 0.1) -> DataFrame:
    """rows (symbol, t0, t1, bin, prob) with ``calibrated``, ``confident`` and ``tag``, fitted on other folds.

    In each purged and embargoed fold, the calibrator is fitted on the train rows' raw
    probabilities and the conformal quantile on their calibrated ones; both are applied to
    the test rows, so no second round of fitting sees a test row. Symbols with fewer than
    two rows a fold get no calibrated value. A fold whose train rows are few or of one
    class flags every test row confident and says so in ``tag``.
    """
    rows = stored(rows)
    known = rows.filter(F.col(prob).isNotNull())
    enough = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * n_folds).select("symbol")
    parts = validation.purged_folds(known.join(enough, "symbol", "left_semi"), n_folds, embargo).select("symbol", "fold", "t0", "part")
    dealt = stored(parts.filter("part in ('train', 'test')").join(known.select("symbol", "t0", "bin", prob), ["symbol", "t0"]))
    by = ["symbol", "fold"]
    train = dealt.filter("part = 'train'")
    fitted = stored(apply_fit(dealt, isotonic(train, prob, "bin", by), prob, by))
    seen = fitted.filter("part = 'train'")
    size = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    whole = size.filter((F.col("n") >= MIN_FOLD_ROWS) & (F.col("low") < F.col("high"))).select(*by)
    q = metrics.conformal_quantile(seen.join(whole, by, "left_semi"), "calibrated", "bin", by, alpha)
    judged = fitted.filter("part = 'test'").join(q, by, "left")
    flag = metrics.conformal_flags(F.col("calibrated"), F.round("qhat", 9))["confident"]
    judged = judged.select(
        "symbol", "t0", "fold", "calibrated", F.coalesce(flag, F.lit(True)).alias("confident"),
        F.when(F.col("qhat").isNull(), "conformal_fold_skipped").alias("tag"),
    )
    return rows.drop("calibrated", "confident", "tag", "fold").join(judged, ["symbol", "t0"], "left").withColumn("confident", F.coalesce("confident", F.lit(True)))


def deploy_fit(rows: DataFrame, prob: str = "prob", late_share: float = 0.3, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(calibration table, (symbol, n, n_fit, qhat, tag)) for scoring rows to come, split by time.

    The earlier rows fit the calibrator, the later ones, calibrated by it, the conformal
    quantile. Symbols of fewer than 40 rows use all of them for both and say so in ``tag``.
    """
    w = Window.partitionBy("symbol")
    share = min(max(late_share, 0.15), 0.5)
    placed = rows.filter(F.col(prob).isNotNull()).withColumns({
        "_i": F.row_number().over(w.orderBy("t0")), "_n": F.count(F.lit(1)).over(w),
    })
    placed = stored(placed)
    few = F.col("_n") < MIN_DEPLOY_ROWS
    late = F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(MIN_CONFORMAL_ROWS))
    placed = placed.withColumns({"_fit": few | (F.col("_i") <= F.col("_n") - late), "_judge": few | (F.col("_i") > F.col("_n") - late)})
    table = stored(isotonic(placed.filter("_fit"), prob, "bin", ["symbol"]))
    q = metrics.conformal_quantile(apply_fit(placed.filter("_judge"), table, prob, ["symbol"]), "calibrated", "bin", ["symbol"], alpha)
    said = placed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_fit"), 1)).alias("n_fit"), F.when(F.max(few), "fitted_and_judged_on_the_same_rows").alias("tag")
    )
    return table, said.join(q, "symbol", "left").select("symbol", "n", "n_fit", "qhat", "tag")
