"""Fitted models as versions in a folder: fit once, store, load, and score new rows by transform alone.

A version holds the refitted experts, the meta model, the calibration table, the conformal
quantiles and, written last, a manifest of one row. A version without manifest is
not there: what a lost driver left half-written is never read, and is overwritten when the same
version is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import calibration, features, learning, metrics
from barflow.operators.crossfit import WHOLE, cross_fit_meta, deal, fit_units, vectors
from barflow.stored import stored

MANIFEST = "version string, columns array<string>, experts array<string>, learned_until timestamp_ntz, n_rows long, selection string"


@dataclass
class Fitted:
    """What scores rows: ``columns`` in, probability and flags out."""

    columns: list[str]
    experts: dict[str, Model]
    meta: Model
    table: DataFrame
    quantiles: DataFrame
    learned_until: object
    n_rows: int
    selection: str
    version: str = "unstored"


def fit(events: DataFrame, columns: list[str], experts: dict | None = None, n_folds: int = 3, embargo: float = 0.01, min_auc: float = 0.5) -> Fitted | None:
    """Fit everything that deployment needs on labelled events (symbol, t0, t1, bin, w and the columns).

    Experts get out-of-fold probabilities on purged folds and are selected by them; the meta
    model is cross-fitted on its own purged folds, and these probabilities fit the calibration
    table and the conformal quantiles, split by time. Then the meta model is fitted on all
    out-of-fold rows and the selected experts on all events. None where the labels are of one class.
    """
    events = stored(events)
    learners = learning.made(experts)
    scored, models = fit_units(deal(learning.one_combination(events, columns), n_folds, embargo), learners)
    inner = stored(scored.filter(F.col("fold") != WHOLE))
    if not models or inner.isEmpty():
        return None
    judged = learning.select_experts(inner).collect()  # a row per expert
    names = sorted(r["expert"] for r in judged if r["kept"] and (0, r["expert"]) in models)
    meta_rows, meta = cross_fit_meta(inner.filter(F.col("expert").isin(names)), names, learning.meta_learner(), n_folds, embargo)
    if (0, "ensemble") not in meta:
        return None
    table, quantiles = calibration.deploy_fit(meta_rows.filter(F.col("fold") != WHOLE), "prob")
    said = "; ".join(f"{r['expert']}: {r['reason']}" for r in judged if r["reason"])
    size = events.agg(F.max("t1").alias("until"), F.count(F.lit(1)).alias("n")).first()
    kept = {n: models[0, n] for n in names}
    return Fitted(columns, kept, meta[0, "ensemble"], table, stored(quantiles), size["until"], size["n"], said)


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def save(fitted: Fitted, folder: str, version: str) -> None:
    """Store a version; one of this name that is complete or half-written is replaced."""
    spark, place = fitted.table.sparkSession, f"{folder}/{version}"
    for name, model in fitted.experts.items():
        model.write().overwrite().save(f"{place}/experts/{name}")
    fitted.meta.write().overwrite().save(f"{place}/meta")
    fitted.table.write.mode("overwrite").parquet(f"{place}/calibration")
    fitted.quantiles.write.mode("overwrite").parquet(f"{place}/quantiles")
    row = (version, fitted.columns, sorted(fitted.experts), fitted.learned_until, fitted.n_rows, fitted.selection)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{place}/manifest")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete versions, in order. A manifest is one row."""
    if not _exists(spark, f"{folder}/*/manifest/_SUCCESS"):
        return []
    return sorted(r[0] for r in spark.read.schema(MANIFEST).parquet(f"{folder}/*/manifest").select("version").collect())


def load(spark: SparkSession, folder: str, version: str | None = None) -> Fitted:
    """A stored version, the last one by name if none is given."""
    known = versions(spark, folder)
    if not known or version not in (None, *known):
        raise ValueError(f"{folder} has no version {version or ''}")
    place = f"{folder}/{version or known[-1]}"
    m = spark.read.schema(MANIFEST).parquet(f"{place}/manifest").first()
    read = lambda at: DefaultParamsReader.loadParamsInstance(at, spark)
    return Fitted(
        m["columns"], {n: read(f"{place}/experts/{n}") for n in m["experts"]}, read(f"{place}/meta"), spark.read.parquet(f"{place}/calibration"),
        spark.read.parquet(f"{place}/quantiles"), m["learned_until"], m["n_rows"], m["selection"], m["version"],
    )


def score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """``rows`` (symbol and features) with ``prob``, ``confident``, ``tag`` and ``version``; nothing is fitted.

    A row that lacks a feature has no probability and is not confident. If whole columns are
    absent, no row is scored and the tag names them. A symbol that the version has not
    seen is scored without calibration and confident, as its tag says.
    """
    names = rows.columns
    rows, missing = features.align_schema(rows, fitted.columns)
    if missing:
        none = {"prob": F.lit(None).cast("double"), "confident": F.lit(False), "tag": F.lit(f"feature_schema_mismatch({','.join(missing)})")}
        return rows.select(*names, *[v.alias(k) for k, v in none.items()], F.lit(fitted.version).alias("version"))
    whole = F.lit(True)
    for c in fitted.columns:
        whole = whole & F.col(c).isNotNull()
    # Nulls are filled so that transforms run; such rows' results are left out, and their own columns stay as given.
    kept = rows.withColumn("_row", F.struct(*[F.col(c) for c in names])).withColumn("_whole", whole)
    scored = vectors(kept.fillna(0.0, subset=fitted.columns), fitted.columns).select("_row", "_whole", F.col("symbol"), "features")
    made = []
    for k, name in enumerate(sorted(fitted.experts)):
        out = fitted.experts[name].transform(scored).withColumn(f"_p{k}", vector_to_array("probability")[1])
        made.append(f"_p{k}")
        scored = out.select("_row", "_whole", "symbol", "features", *made)
    meta = fitted.meta.transform(vectors(scored.select("_row", "_whole", "symbol", *made), made))
    raw = meta.select("_row", "_whole", "symbol", vector_to_array("probability")[1].alias("_raw"))
    judged = calibration.apply_fit(raw, fitted.table, "_raw", ["symbol"]).join(fitted.quantiles.select("symbol", "qhat", F.col("tag").alias("_tag")), "symbol", "left")
    flag = metrics.conformal_flags(F.col("calibrated"), F.col("qhat"))["confident"]
    tag = F.when(~F.col("_whole"), "feature_missing").when(F.col("calibrated").isNull(), "not_calibrated").otherwise(F.col("_tag"))
    return judged.select(
        "_row.*", F.when(F.col("_whole"), F.coalesce("calibrated", "_raw")).alias("prob"),
        (F.col("_whole") & F.coalesce(flag, F.lit(True))).alias("confident"), tag.alias("tag"), F.lit(fitted.version).alias("version"),
    )
