"""The live loop: ticks arrive, bars follow, a stored model decides on each symbol's last complete bar.

Everything happens in ``foreachBatch`` and is idempotent by batch: ticks and bars are merged
by key into the days they touch, a batch's model version follows from its number, and its
decisions are one folder that is written over. A batch that is run again after a failure leaves
what it left before, and each decision is there once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators import backtest, lifecycle
from barflow.operators.backtest import Rules
from barflow.sources import bars as source
from barflow.sources import tables

DECISIONS = (
    "symbol string, ts timestamp_ntz, signal string, win_probability double, suggested_position_pct double, stop_loss double, take_profit double, "
    "reason string, version string, last_signal string, notify boolean, batch long"
)


@dataclass
class Loop:
    """Where the loop's tables lie, how bars become features and labels, and how often it learns anew.

    ``features(bars)`` gives rows (symbol, ts, close, side, trgt, event and the model's columns) and
    ``labelled(rows)`` the events to learn from; ``event`` says whether a bar may be traded.
    """

    folder: str
    features: Callable[[DataFrame], DataFrame]
    labelled: Callable[[DataFrame], DataFrame]
    columns: list[str]
    rules: Rules
    experts: dict | None = None
    retrain_every: int = 24
    notify_hold: bool = False

    def place(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def pinned(self, spark: SparkSession, batch: int, rows: DataFrame) -> lifecycle.Fitted | None:
        """The version of a batch, that of the last training batch; fitted now if it is not stored yet.

        None where the labels so far do not allow a fit; the version before it serves then, if there is one.
        """
        wanted = f"v{batch // self.retrain_every * self.retrain_every:010d}"
        known = lifecycle.versions(spark, self.place("models"))
        if wanted not in known:
            fitted = lifecycle.fit(self.labelled(rows), self.columns, self.experts)
            if fitted is not None:
                lifecycle.save(fitted, self.place("models"), wanted)
                known.append(wanted)
        usable = [v for v in known if v <= wanted]
        return lifecycle.load(spark, self.place("models"), max(usable)) if usable else None

    def decide(self, spark: SparkSession, batch: int) -> DataFrame:
        """A decision for each symbol's last complete bar; the latest bar of all may still grow and is left out."""
        bars = spark.read.parquet(self.place("bars")).drop("day")
        complete = bars.join(F.broadcast(bars.agg(F.max("ts").alias("_now"))), F.col("ts") < F.col("_now")).drop("_now")  # one row
        rows = self.features(complete)
        fitted = self.pinned(spark, batch, rows)
        last = source.keep_first(rows.filter("side is not null and trgt is not null"), ["symbol"], [F.desc("ts")])
        if fitted is None:
            scored = last.withColumns({"prob": F.lit(None).cast("double"), "confident": F.lit(False), "tag": F.lit("no_model"), "version": F.lit(None).cast("string")})
        else:
            scored = lifecycle.score(fitted, last)
        columns = backtest.decide(F.col("prob"), F.col("side"), F.col("close"), F.col("trgt") * F.col("close"), F.col("confident"), self.rules)
        columns = backtest.hold_unless(columns, F.col("event"), "not_cusum_event")
        columns = backtest.hold_unless(columns, F.col("prob").isNotNull(), "not_scored")
        columns["reason"] = F.when(F.col("prob").isNull(), F.coalesce("tag", F.lit("not_scored"))).otherwise(columns["reason"])
        names = ("signal", "win_probability", "suggested_position_pct", "stop_loss", "take_profit", "reason")
        return scored.select("symbol", "ts", *[columns[c].alias(c) for c in names], "version")

    def with_notice(self, spark: SparkSession, decided: DataFrame, batch: int) -> DataFrame:
        """Decisions with the signal before and whether to send them: a signal other than the last, and no HOLD unless asked for."""
        path = f"{self.place('decisions')}/batch={batch - 1}"
        if tables.exists(spark, path):
            before = spark.read.parquet(path).select("symbol", F.col("signal").alias("last_signal"))
            decided = decided.join(before, "symbol", "left")
        else:
            decided = decided.withColumn("last_signal", F.lit(None).cast("string"))
        worth = F.lit(self.notify_hold) | (F.col("signal") != "HOLD")
        return decided.withColumn("notify", worth & ~F.col("signal").eqNullSafe(F.col("last_signal")))

    def batch(self, ticks: DataFrame, number: int) -> None:
        spark = ticks.sparkSession
        tables.merge_ticks(ticks.withColumn("ts", F.col("ts").cast("timestamp_ntz")), self.place("ticks"), self.place("bars"))
        if tables.exists(spark, self.place("bars")):
            found = self.with_notice(spark, self.decide(spark, number), number)
            found.coalesce(1).write.mode("overwrite").parquet(f"{self.place('decisions')}/batch={number}")

    def run(self, ticks: DataFrame) -> None:
        """Work through all that has arrived, from where the checkpoint says the loop stopped."""
        ticks.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.place("checkpoint")).trigger(availableNow=True).start().awaitTermination()

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(DECISIONS).option("basePath", self.place("decisions")).parquet(self.place("decisions"))
