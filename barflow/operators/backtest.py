"""Sizing, decisions and back-tests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import expm1

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators import metrics


@dataclass(frozen=True)
class Rules:
    """Thresholds, costs as fractions, and limits."""

    prob_threshold: float = 0.55
    fee: float = 5e-4
    slip: float = 2e-4
    funding: float = 0.0
    payoff: float = 1.0
    take: float = 1.5
    stop: float = 1.5
    kelly: float = 0.5
    max_position: float = 0.3
    min_position: float = 0.01
    max_gross: float = 1.0
    daily_drawdown: float = 0.05
    roundtrip_cost: float | None = None
    execution: str = "close_fill"

    def __post_init__(self) -> None:
        if self.execution != "close_fill":
            raise ValueError(f"execution {self.execution!r} is not supported; only close_fill is")

    @property
    def cost(self) -> float:
        return 2 * (self.fee + self.slip) if self.roundtrip_cost is None else self.roundtrip_cost


def position_size(prob: Column, rules: Rules) -> Column:
    """Fraction of equity by the Kelly rule after cost, scaled and capped; never negative."""
    b = max(rules.payoff, 1e-6)
    edge = (prob * (b + 1) - 1 - max(rules.cost, 0.0)) / b
    return F.least(F.greatest(edge, F.lit(0.0)) * rules.kelly, F.lit(rules.max_position))


def decide(prob: Column, side: Column, price: Column, atr: Column, confident: Column, rules: Rules) -> dict[str, Column]:
    """Signal, size, levels and reason as columns; a HOLD has no levels."""
    size = position_size(prob, rules)
    reason = (
        F.when(~confident, "low_confidence_conformal").when(side == 0, "no_side")
        .when(prob < rules.prob_threshold, "prob_below_threshold").when(size <= 0, "kelly_non_positive_after_cost")
    )
    hold = reason.isNotNull()
    return {
        "signal": F.when(hold, "HOLD").when(side > 0, "LONG").otherwise("SHORT"),
        "win_probability": F.round(prob, 4), "entry_price": F.round(price, 2),
        "suggested_position_pct": F.when(hold, 0.0).otherwise(F.round(size, 4)), "atr": F.round(atr, 4),
        "stop_loss": F.when(~hold, F.round(price - side * rules.stop * atr, 2)),
        "take_profit": F.when(~hold, F.round(price + side * rules.take * atr, 2)), "reason": reason,
    }


def hold_unless(columns: dict[str, Column], allowed: Column, reason: str) -> dict[str, Column]:
    """The columns of ``decide``, held for ``reason`` and without a probability where ``allowed`` is false."""
    held = {"signal": F.lit("HOLD"), "suggested_position_pct": F.lit(0.0), "reason": F.lit(reason)}
    blank = ("win_probability", "stop_loss", "take_profit")
    return {k: F.when(allowed, v).otherwise(held[k]) if k in held else F.when(allowed, v) if k in blank else v for k, v in columns.items()}


#: What a reader is told of each reason to hold, and the labels of a decision's lines.
HOLD_TEXTS = {
    "feature_schema_mismatch": "特征 schema 与训练不一致, 强制观望",
    "not_cusum_event": "非 CUSUM 事件 bar, 与训练开仓门控对齐",
    "no_valid_feature_bar": "无完整特征 bar",
    "low_confidence_conformal": "保形预测弃权(不自信)",
    "prob_below_threshold": "盈利概率未达入场阈值",
    "kelly_non_positive_after_cost": "扣成本后 Kelly 仓位非正",
    "no_side": "无有效主信号方向",
}
LINES = {
    "win_probability": "盈利概率: ", "entry_price": "入场价:   ", "stop_loss": "止损:     ", "take_profit": "止盈:     ",
    "suggested_position_pct": "建议仓位: ", "atr": "ATR:      ",
}


def decision_text(at: str = "ts") -> Column:
    """A decision (columns of ``decide``, symbol and its time) as text; numbers as Spark writes them, None for null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    why = F.coalesce(*[F.when(F.col("reason").contains(k), v) for k, v in HOLD_TEXTS.items()], F.concat(F.lit("原因: "), "reason"), F.lit("观望(未满足开仓条件)"))
    when = F.concat(F.lit("\n时间: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    held = F.concat(F.lit("[观望] "), "symbol", F.lit("\n概率="), said("win_probability"), F.lit("  ("), why, F.lit(")"), when)
    head = F.concat(F.lit("["), F.when(F.col("signal") == "LONG", "做多 LONG").otherwise("做空 SHORT"), F.lit("] "), "symbol")
    lines = [F.concat(F.lit("\n" + label), said(c)) for c, label in LINES.items()]
    return F.when(F.col("signal") == "HOLD", held).otherwise(F.concat(head, *lines, when))


def hold_for_schema(rows: DataFrame, missing: list[str], shown: int = 12) -> DataFrame:
    """A HOLD for each row (symbol, ts) whose features lack columns that the model knows; no rows if none is missing."""
    if not missing:
        rows = rows.limit(0)
    more = f",+{len(missing) - shown}more" if len(missing) > shown else ""
    tag = f"feature_schema_mismatch({','.join(missing[:shown])}{more})"
    none = F.lit(None).cast("double")
    return rows.select(
        "symbol", "ts", F.lit("HOLD").alias("signal"), F.lit("feature_schema_mismatch").alias("reason"), F.lit(tag).alias("tag"),
        none.alias("win_probability"), F.lit(0.0).alias("suggested_position_pct"), none.alias("stop_loss"), none.alias("take_profit"),
        F.lit(False).alias("confident"), F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing"),
    )


def independent(events: DataFrame, rules: Rules) -> DataFrame:
    """Each trade alone on the whole equity, compounding: size, pnl, halted and equity after each event in order of t0.

    A day (of t0) is halted once the product of its own gains has fallen by the daily
    limit: that depends on the day's earlier trades alone, so days are independent.
    """
    enters = F.col("confident") & (F.col("prob") >= rules.prob_threshold)
    wanted = F.when(enters, position_size(F.col("prob"), rules)).otherwise(0.0)
    rows = events.filter("prob is not null and ret is not null").withColumn("_size", wanted)
    cost = F.col("_size") * (2 * (rules.fee + rules.slip) + rules.funding * F.col("bars_held"))
    rows = rows.withColumn("_pnl", F.col("_size") * (F.exp("ret") - 1) - cost)
    day = Window.partitionBy("symbol", F.to_date("t0")).orderBy("t0")
    halted = F.lit(False)
    if rules.daily_drawdown > 0:
        rows = rows.withColumn("_run", F.exp(F.sum(F.log1p("_pnl")).over(day.rowsBetween(Window.unboundedPreceding, 0))))
        lowest = F.min("_run").over(day.rowsBetween(Window.unboundedPreceding, -1))
        halted = F.coalesce(lowest <= 1 - rules.daily_drawdown, F.lit(False))
    rows = rows.withColumn("halted", halted).withColumns({
        "size": F.when(F.col("halted"), 0.0).otherwise(F.col("_size")), "pnl": F.when(F.col("halted"), 0.0).otherwise(F.col("_pnl")),
    }).drop("_size", "_pnl", "_run")
    w = Window.partitionBy("symbol").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("equity", F.exp(F.sum(F.log1p("pnl")).over(w)))


def rollup(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """Metrics of a back-test per symbol; ratios a year count overlapping trades by their uniqueness."""
    traded = F.col("size") > 0
    peak = F.max("equity").over(Window.partitionBy(by).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    seconds = F.unix_micros(F.max("t0").cast("timestamp")) / 1e6 - F.unix_micros(F.min("t0").cast("timestamp")) / 1e6
    base = trades.withColumn("_down", (F.col("equity") - peak) / peak).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_events"), F.count(F.when(traded, 1)).alias("n_trades"), F.count(F.when(F.col("halted"), 1)).alias("n_halted"),
        (F.max_by("equity", "t0") - 1).alias("total_return"), F.min("_down").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(traded, (F.col("pnl") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(traded, F.col("pnl"))), F.lit(0.0)).alias("avg_pnl"), (seconds / 86400).alias("_days"),
    )
    unique = metrics.time_uniqueness(trades.filter(traded), by).groupBy(by).agg(F.avg("uniq").alias("avg_uniqueness"))
    out = base.join(unique, by, "left").join(metrics.per_trade_sharpe(trades, "pnl", [by]), by).withColumn("avg_uniqueness", F.coalesce("avg_uniqueness", F.lit(1.0)))
    out = out.withColumn("n_trades_effective", F.col("n_trades") * F.col("avg_uniqueness"))
    counts = (F.col("n_events") >= 2) & (F.col("n_trades_effective") >= 2) & (F.col("_days") > 0)
    a_year = F.when(counts, F.col("n_trades_effective") / F.nullif(F.col("_days") / 365.25, F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("periods_per_year", a_year)
    return out.withColumns({
        "sharpe_annualized": F.col("sharpe") * F.sqrt("periods_per_year"), "calmar": F.col("total_return") / (F.abs("max_drawdown") + 1e-9),
    }).drop("_days")


def combination_ratios(rows: DataFrame, rules: Rules) -> DataFrame:
    """(symbol, expert, combo, n_trades, sharpe): the independent back-test of each combination's test rows."""
    name = F.concat_ws("|", "symbol", "expert", F.col("combo").cast("string"))
    trades = independent(rows.withColumns({"_symbol": F.col("symbol"), "symbol": name}), rules)
    ratios = metrics.per_trade_sharpe(trades, "pnl", ["symbol"])
    n = trades.groupBy("symbol", "_symbol", "expert", "combo").agg(F.count(F.when(F.col("size") > 0, 1)).alias("n_trades"))
    return n.join(ratios, "symbol").select(F.col("_symbol").alias("symbol"), "expert", "combo", "n_trades", "sharpe")


DETAIL = "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, size double, pnl double, entry_equity double, halted boolean, skipped_capacity boolean"
POINTS = "symbol string, ts timestamp_ntz, seq long, equity double, marked double"


class _Book:
    """Open positions and equity of one portfolio."""

    def __init__(self) -> None:
        self.equity, self.locked, self.open = 1.0, 0.0, {}
        self.day, self.day_start, self.halted = None, 1.0, False

    def marked(self, price: float | None) -> float:
        if price is None or price != price or price <= 0:
            return self.equity
        floating = sum(p["entry"] * p["size"] * p["side"] * (price / p["price"] - 1) for p in self.open.values() if p["price"])
        return self.equity + floating

    def turn(self, day: object, marked: float, limit: float) -> None:
        if day != self.day:
            self.day, self.day_start, self.halted = day, marked, False
        if limit > 0 and marked <= self.day_start * (1 - limit):
            self.halted = True


def _simulate(rules: Rules, want: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, book, seq = None, _Book(), 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, book, seq = r.symbol, _Book(), 0
                marked = book.marked(r.price)
                book.turn(r.at.date(), marked, rules.daily_drawdown)
                seq += 1
                if want == "points":
                    rows.append((symbol, r.at, seq, None, marked))
                if r.kind == 0:
                    held = book.open.pop(r.event, None)
                    if held is None:
                        continue
                    gain = held["size"] * expm1(r.ret) - held["size"] * (2 * (rules.fee + rules.slip) + rules.funding * r.bars_held)
                    book.equity += held["entry"] * gain
                    book.locked = max(0.0, book.locked - held["size"])
                    seq += 1
                    if want == "points":
                        rows.append((symbol, r.at, seq, book.equity, book.marked(r.price)))
                    else:
                        rows.append((symbol, r.t0, r.at, held["size"], gain, held["entry"], False, False))
                    continue
                if book.halted or not r.confident or r.prob < rules.prob_threshold:
                    if want == "detail":
                        rows.append((symbol, r.at, r.t1, 0.0, 0.0, 0.0, book.halted, False))
                    continue
                size = min(r.want, max(0.0, rules.max_gross - book.locked))
                if size < rules.min_position:
                    if want == "detail":
                        rows.append((symbol, r.at, r.t1, 0.0, 0.0, 0.0, False, True))
                    continue
                book.locked += size
                price = r.price if r.price is not None and r.price > 0 else None
                book.open[r.event] = {"size": size, "entry": book.equity, "side": r.side, "price": price}
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in (POINTS if want == "points" else DETAIL).split(", ")])

    return run


def timeline(events: DataFrame, bars: DataFrame, rules: Rules) -> DataFrame:
    """Exits and entries of every event with the close of their bar, exits first at one time."""
    rows = events.filter("prob is not null and ret is not null and t1 is not null").withColumn("want", position_size(F.col("prob"), rules))
    rows = rows.withColumn("event", F.row_number().over(Window.partitionBy("symbol").orderBy("t0", "t1")).cast("long"))
    names = ["symbol", "event", "t0", "t1", "side", "ret", "bars_held", "prob", "confident", "want"]
    both = rows.select(*names, F.explode(F.array(
        F.struct(F.col("t1").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("t0").alias("at"), F.lit(1).alias("kind"))
    )).alias("p")).select(*names, "p.at", "p.kind")
    return both.join(bars.select("symbol", F.col("ts").alias("at"), F.col("close").alias("price")), ["symbol", "at"], "left")


def portfolio(events: DataFrame, bars: DataFrame, rules: Rules, want: str = "detail") -> DataFrame:
    """One portfolio per symbol on shared equity with locked exposure, a daily halt and marking to market.

    Gains are added on the equity at entry. ``want`` is "detail" (a row per event) or
    "points" (the equity curve). The order of fills is the semantics, so it is folded in
    time order; what is held is the open positions.
    """
    ordered = timeline(events, bars, rules).repartition("symbol").sortWithinPartitions("symbol", "at", "kind", "event")
    return ordered.mapInPandas(_simulate(rules, want), POINTS if want == "points" else DETAIL)
