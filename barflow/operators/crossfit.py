"""Cross-fitting by label intervals: many fits on purged folds of many combinations, submitted side by side.

Which rows a fit may learn from is decided by their label intervals, not by row numbers: every
event of a combination is dealt to each fold as test, train or neither (``validation``), in
one job for all folds and combinations. A unit is one combination, fold and learner; it
reads its own partition of the dealt table and writes its own folder of probabilities, so units
run in any order and a repeated one leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barflow.operators import validation
from barflow.stored import shared_folder, stored

#: The fold of the fit on all train rows of a combination.
WHOLE = -1
#: Jobs that a pool keeps running at a time.
PARALLEL = 4
Make = Callable[[Row], Estimator]


def vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def in_pool(spark: SparkSession, jobs: list[Callable[[], object]], parallel: int = PARALLEL) -> list:
    """The results of driver functions that each submit jobs of their own, ``parallel`` at a time."""
    pool = ThreadPool(max(1, min(parallel, len(jobs))))
    try:
        run = inheritable_thread_target(spark)(lambda job: job())
        return pool.map(run, jobs, chunksize=1)
    finally:
        pool.close()


def series_key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def deal(rows: DataFrame, n_folds: int, embargo: float) -> DataFrame:
    """rows (combo, symbol, t0, t1, outer, ...) dealt to folds: with ``fold``, ``part`` (train or test) and ``fallback``.

    Rows whose ``outer`` is train are split into purged and embargoed folds of their
    combination and symbol; purged and embargoed rows are in neither part. The fold
    ``WHOLE`` has all of them as train and the outer test rows as test. A combination with fewer than two
    train rows a fold is not split: its one fold has them all as both, which ``fallback`` says.
    """
    key = series_key("combo", "symbol")
    train = rows.filter("outer = 'train'")
    sizes = train.groupBy("combo").agg((F.count(F.lit(1)) < 2 * n_folds).alias("fallback"))
    known = rows.join(sizes, "combo", "left").withColumn("fallback", F.coalesce("fallback", F.lit(False)))
    known = stored(known.withColumn("_key", key))
    split = known.filter("outer = 'train' and not fallback")
    parts = validation.purged_folds(split.select(F.col("_key").alias("symbol"), "t0", "t1"), n_folds, embargo)
    parts = parts.filter("part in ('train', 'test')").select(F.col("symbol").alias("_key"), "t0", "fold", "part")
    inner = split.join(parts, ["_key", "t0"])
    both = known.filter("outer = 'train' and fallback").withColumns({"fold": F.lit(0), "part": F.explode(F.array(F.lit("train"), F.lit("test")))})
    whole = known.withColumns({"fold": F.lit(WHOLE), "part": F.col("outer")})
    names = inner.columns
    return inner.union(both.select(*names)).union(whole.select(*names)).drop("_key", "outer")


def fit_units(dealt: DataFrame, experts: dict[str, Make], parallel: int = PARALLEL, whole_only: bool = False) -> tuple[DataFrame, dict[tuple[int, str], Model]]:
    """(combo, fold, expert, symbol, t0, t1, bin, w, fallback, prob) of all test rows, and the models of the folds ``WHOLE``.

    A unit whose train rows are of one class is not fitted and its test rows have no row.
    """
    spark = dealt.sparkSession
    table = stored(dealt.withColumn("bin", F.col("bin").cast("int")), partition_by=["combo", "fold"])
    unit = table.filter("part = 'train'").groupBy("combo", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.countDistinct("bin").alias("classes")
    )
    found = sorted(r for r in unit.collect() if r["classes"] == 2 and (r["fold"] == WHOLE or not whole_only))  # one row a unit
    folder = shared_folder(spark)
    schema = "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, bin int, w double, fallback boolean, prob double, combo int, fold int, expert string"

    def job(r: Row, name: str) -> Callable[[], tuple]:
        def run() -> tuple:
            mine = table.filter((F.col("combo") == r["combo"]) & (F.col("fold") == r["fold"]))
            model = experts[name](r).fit(mine.filter("part = 'train'"))
            scored = model.transform(mine.filter("part = 'test'")).select(
                "symbol", "t0", "t1", "bin", F.col("w").cast("double").alias("w"), "fallback", vector_to_array("probability")[1].alias("prob")
            )
            scored.write.mode("overwrite").parquet(f"{folder}/combo={r['combo']}/fold={r['fold']}/expert={name}")
            return (r["combo"], name), model if r["fold"] == WHOLE else None

        return run

    made = in_pool(spark, [job(r, name) for r in found for name in experts], parallel)
    models = {key: model for key, model in made if model is not None}
    if not found:
        return spark.createDataFrame([], schema), models
    return spark.read.schema(schema).option("basePath", folder).parquet(folder), models


def widened(scored: DataFrame, names: list[str]) -> DataFrame:
    """One row per event and fold with the experts' probabilities as ``features``; events that lack one are left out."""
    keys = ["combo", "fold", "symbol", "t0", "t1", "bin", "w"]
    each = [F.max(F.when(F.col("expert") == n, F.col("prob"))).alias(f"p_{k}") for k, n in enumerate(names)]
    return vectors(scored.groupBy(*keys).agg(*each).dropna(), [f"p_{k}" for k in range(len(names))])


def cross_fit_meta(scored: DataFrame, names: list[str], make: Make, n_folds: int, embargo: float, parallel: int = PARALLEL) -> tuple[DataFrame, dict]:
    """As ``fit_units``, for a meta model over the experts' out-of-fold probabilities.

    It is cross-fitted on purged folds of its own: no train label of it meets the labels of
    its test fold. Its fold ``WHOLE`` learns from all out-of-fold rows and scores the outer test rows.
    """
    wide = widened(scored, names)
    rows = wide.withColumn("outer", F.when(F.col("fold") == WHOLE, "test").otherwise("train")).drop("fold")
    return fit_units(deal(stored(rows), n_folds, embargo), {"ensemble": make}, parallel)
