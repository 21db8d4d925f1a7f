"""Exponentially weighted means as two short scans.

y_k = alpha x_k + (1 - alpha) y_(k-1) is an affine map, so a series is cut into chunks:
a window inside each chunk gives the mean that starts from zero, a fold over one row per
chunk gives the value carried into each, and both add up. No row needs its whole history.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.functions.windows import EPS, lagged

CHUNK = 512


def _carried(k: int, q: float) -> Callable[[Column, Column], Column]:
    """Adds to the values carried into chunks the one after chunk e, for mean number k."""
    return lambda a, e: F.concat(a, F.array(F.element_at(a, -1) * F.pow(F.lit(q), e[f"_len{k}"].cast("double")) + e[f"_end{k}"]))


def _first(k: int) -> Callable[[Column], Column]:
    """The first value of chunk e, for mean number k."""
    return lambda e: e[f"_x{k}"]


def ewm(df: DataFrame, means: dict[str, tuple[str, float]], by: str = "symbol", order: str = "ts") -> DataFrame:
    """``df`` with a column out = mean of col by alpha for each out: (col, alpha).

    Rows where its column is null have no mean and are passed over; the first other row
    starts it. All means of one call share one pass, so name them together.
    """
    chunk = int(min([CHUNK, *(500 / -log(1 - alpha) for _, alpha in means.values() if alpha < 1)]))
    names = df.columns
    base = df.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / chunk))
    inside = Window.partitionBy(by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    columns = {c: k for k, c in enumerate(dict.fromkeys(c for c, _ in means.values()))}
    base = base.withColumns({f"_k{k}": F.count(c).over(inside) for c, k in columns.items()})
    local, parts, folds = {}, [], []
    for k, (col, alpha) in enumerate(means.values()):
        q, seen = 1 - alpha, F.col(f"_k{columns[col]}").cast("double")
        term = F.when(F.col(col).isNotNull(), alpha * F.col(col) * F.pow(F.lit(q), -seen))
        local[f"_y{k}"] = F.coalesce(F.pow(F.lit(q), seen) * F.sum(term).over(inside), F.lit(0.0))
        first = F.min_by(col, F.when(F.col(col).isNotNull(), seen))
        parts += [F.max(seen).alias(f"_len{k}"), F.max_by(f"_y{k}", seen).alias(f"_end{k}"), first.alias(f"_x{k}")]
        start = F.get(F.filter(F.transform("_e", _first(k)), lambda x: x.isNotNull()), F.lit(0))
        folds.append(F.aggregate("_e", F.array(start), _carried(k, q)).alias(f"_carry{k}"))
    base = base.withColumns(local)
    ends = base.groupBy(by, "_chunk").agg(*parts)
    held = ["_chunk", *(f"_{p}{k}" for k in range(len(means)) for p in ("len", "end", "x"))]
    folded = ends.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("_e")).select(by, *folds)
    carry = folded.select(by, F.posexplode(F.arrays_zip(*[f"_carry{k}" for k in range(len(means))])).alias("_chunk", "_c"))
    carry = carry.select(F.col(by), F.col("_chunk").cast("long").alias("_chunk"), "_c")
    joined = base.join(carry, [by, "_chunk"], "left")
    values = {}
    for k, (out, (col, alpha)) in enumerate(means.items()):
        back = F.pow(F.lit(1 - alpha), F.col(f"_k{columns[col]}").cast("double")) * F.col("_c")[f"_carry{k}"]
        values[out] = F.when(F.col(col).isNotNull(), F.col(f"_y{k}") + back)
    return joined.withColumns(values).select(*[c for c in names if c not in means], *means)


def span(n: int) -> float:
    return 2 / (n + 1)


def moves(df: DataFrame) -> DataFrame:
    """df with rises, falls and true ranges; the first bar neither rises nor falls."""
    before = lagged(F.col("close"), 1)
    change = F.col("close") - before
    return df.withColumns({
        "_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
    })


def indicators(df: DataFrame, rsi: dict[str, int] | None = None, atr: dict[str, int] | None = None, macd: bool = False) -> DataFrame:
    """df with the named RSIs and ATRs (name: window) and, if asked, MACD: one pass, and one more for MACD's signal."""
    rsi, atr = rsi or {}, atr or {}
    means = {f"_{side}_{out}": (f"_{side}", 1 / n) for out, n in rsi.items() for side in ("up", "down")}
    means |= {out: ("_tr", 1 / n) for out, n in atr.items()}
    if macd:
        means |= {"_fast": ("close", span(12)), "_slow": ("close", span(26))}
    out = ewm(moves(df) if rsi or atr else df, means)
    made = {name: F.col(name) for name in atr}
    made |= {name: 100 - 100 / (1 + F.col(f"_up_{name}") / (F.col(f"_down_{name}") + EPS)) for name in rsi}
    if macd:
        out = ewm(out.withColumn("_macd", F.col("_fast") - F.col("_slow")), {"_signal": ("_macd", span(9))})
        close = F.col("close") + EPS
        made |= {
            "macd": F.col("_macd") / close, "macd_signal": F.col("_signal") / close, "macd_hist": (F.col("_macd") - F.col("_signal")) / close,
        }
    return out.select(*[c for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def rsi(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength by Wilder means of rises and falls; the first bar has none."""
    return indicators(df, rsi={out: n})


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Wilder mean of the true range."""
    return indicators(df, atr={out: n})


def macd(df: DataFrame) -> DataFrame:
    """macd, macd_signal and macd_hist relative to the close."""
    return indicators(df, macd=True)
