"""Integrity checks as rows: what must hold of labels, folds, ledger and features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators import backtest, ewm, labels, learning, metrics, validation
from barflow.operators.backtest import Rules
from barflow.stored import stored


def check(df: DataFrame, name: str, value: Column, holds) -> DataFrame:
    """One row (name, status, value): an aggregate of ``df`` and whether it holds; an empty table passes."""
    row = df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    return row.select(F.lit(name).alias("name"), F.when(holds(F.col("value")), "PASS").otherwise("FAIL").alias("status"), F.round("value", 9).alias("value"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (symbol, fold, t0) whose part is not the same in both."""
    keys = ["symbol", "fold", "t0"]
    both = a.select(*keys, F.col("part").alias("x")).join(b.select(*keys, F.col("part").alias("y")), keys, "full")
    return both.filter(~F.col("x").eqNullSafe(F.col("y")))


def audit(bars: DataFrame, events: DataFrame, rules: Rules, folds: int = 5, embargo: float = 0.02) -> DataFrame:
    """(name, status, value) for every check; nothing is collected. What several checks read is stored once."""
    events, bars = stored(events), stored(bars)
    split = stored(validation.purged_folds(events, folds, embargo))
    detail = stored(backtest.portfolio(events, bars, rules))
    points = backtest.portfolio(events, bars, rules, "points").filter("equity is not null")
    ends = points.groupBy("symbol").agg(F.max_by("equity", F.struct("ts", "seq")).alias("end"))
    sums = detail.groupBy("symbol").agg((1 + F.sum(F.col("entry_equity") * F.col("pnl"))).alias("total"))
    cost = lambda fee: backtest.independent(events, replace(rules, fee=fee, roundtrip_cost=0.0)).groupBy("symbol").agg(F.sum("pnl").alias(f"p{int(fee * 1e4)}"))
    early = ewm.atr(bars.filter(F.dayofmonth("ts") <= 15), 14, "early").select("symbol", "ts", "early")
    whole = ewm.atr(bars, 14, "whole").select("symbol", "ts", "whole")
    zero = lambda v: v == 0
    rows = [
        check(events, "label_ends_after_it_starts", F.count(F.when(F.col("t1") <= F.col("t0"), 1)), zero),
        check(events, "no_missing_label", F.count(F.when(F.col("bin").isNull() | F.col("ret").isNull(), 1)), zero),
        check(events, "both_classes", F.avg("bin"), lambda v: (v > 0.02) & (v < 0.98)),
        check(validation.overlaps(split), "no_fold_overlap", F.sum("n_overlaps"), zero),
        check(sums.join(ends, "symbol"), "ledger_reconciles", F.max(F.abs(F.col("total") - F.col("end"))), lambda v: v <= 1e-9),
        check(metrics.peak_exposure(detail.filter("size > 0")), "gross_exposure", F.max("peak"), lambda v: v <= rules.max_gross + 1e-9),
        check(cost(0.0).join(cost(0.005), "symbol"), "fees_cost", F.max(F.col("p50") - F.col("p0")), lambda v: v <= 0),
        check(early.join(whole, ["symbol", "ts"]), "features_ignore_the_future", F.max(F.abs(F.col("early") - F.col("whole"))), lambda v: v <= 1e-9),
    ]
    week = F.expr("interval 7 days")
    shifted = validation.purged_folds(events.withColumns({"t0": F.col("t0") + week, "t1": F.col("t1") + week}), folds, embargo).withColumn("t0", F.col("t0") - week)
    dealt = validation.purged_folds(events.repartition(7, "t1"), folds, embargo)
    weighted = stored(labels.combined_weights(labels.uniqueness(bars, events)))
    curve = metrics.drawdowns(backtest.independent(events, rules), "equity", ["symbol"], ["t0"])
    none = metrics.auc(learning.hit_rate(learning.permuted(events.drop("prob", "confident"), 5)).filter("seed > 0"), "prob", "bin", ["seed"])
    outside = lambda c, low, high: F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1))
    rows += [
        check(validation.embargo_violations(events, split, folds, embargo), "embargo_holds", F.count(F.lit(1)), zero),
        check(validation.combination_overlaps(events, 6, 2, embargo), "no_combination_overlap", F.sum("n_overlaps"), zero),
        check(none, "permuted_labels_show_nothing", F.max("auc"), lambda v: v <= 0.58),
        check(differing(split, shifted), "folds_ignore_the_calendar", F.count(F.lit(1)), zero),
        check(differing(split, dealt), "folds_ignore_the_order_of_rows", F.count(F.lit(1)), zero),
        check(events.groupBy("symbol", "t0").count(), "one_event_a_bar", F.count(F.when(F.col("count") > 1, 1)), zero),
        check(bars.groupBy("symbol", "ts").count(), "one_bar_a_time", F.count(F.when(F.col("count") > 1, 1)), zero),
        check(bars, "high_is_not_below_low", F.count(F.when(F.col("high") < F.col("low"), 1)), zero),
        check(events, "labels_agree_with_returns", F.count(F.when((F.col("bin") == 1) != (F.col("ret") > 0), 1)), zero),
        check(events, "probabilities_are_probabilities", outside("prob", 0, 1), zero),
        check(detail, "sizes_within_the_cap", outside("size", 0, rules.max_position + 1e-9), zero),
        check(weighted, "uniqueness_is_a_share", outside("uniq", 1e-12, 1 + 1e-9), zero),
        check(weighted.groupBy("symbol").agg(F.avg("w").alias("m")), "weights_have_mean_one", F.max(F.abs(F.col("m") - 1)), lambda v: v <= 1e-6),
        check(curve, "drawdown_is_a_share", outside("max_drawdown", -1, 0), zero),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out
