"""Common table expressions of the DuckDB statements."""

from __future__ import annotations

TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS tick_id, value AS price FROM events WHERE value > 0)"
BARS = f"""{TICKS},
bars AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(price, (ts, tick_id)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (ts, tick_id)) AS close, sum(price) AS volume FROM ticks GROUP BY ALL)"""
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def coarse(hours: int, name: str, source: str = "bars") -> str:
    start = f"make_timestamp((floor(epoch(ts) / {3600 * hours}) * {3600 * hours} * 1000000)::BIGINT)"
    return f"""{name} AS (SELECT symbol, {start} AS bar, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume FROM {source} GROUP BY ALL)"""


def rolling(fn: str, x: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END)"


def mean(x: str, alpha: float, order: str = "ts") -> str:
    """Exponentially weighted mean of all values so far; leading nulls are passed over."""
    window = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) {window}, lambda a, x: {1 - alpha!r}::DOUBLE * a + {alpha!r}::DOUBLE * x)"


ATR = f"""tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}),
atr AS (SELECT *, {mean('tr', 1 / 14)} AS atr_14 FROM tr)"""
SIDES = f"""sided AS (SELECT *, CASE WHEN close / lag(close, 24) OVER w - 1 >= 0 THEN 1.0::DOUBLE
  WHEN close / lag(close, 24) OVER w - 1 < 0 THEN -1.0::DOUBLE END AS side, atr_14 / nullif(close, 0) AS trgt,
  row_number() OVER w AS rn FROM atr {W})"""
#: Triple-barrier labels of every bar, by a range join on row numbers.
LABELLED = """cand AS (SELECT a.symbol, a.rn, a.ts AS t0, a.side, a.trgt, a.close, e.ts AS te, e.close AS ce,
  a.close + a.side * 1.5::DOUBLE * greatest(a.trgt, 0) * a.close AS tp, a.close - a.side * 1.5::DOUBLE * greatest(a.trgt, 0) * a.close AS sl
  FROM sided a JOIN sided e ON e.symbol = a.symbol AND e.rn = a.rn + 24 WHERE a.side IS NOT NULL AND a.trgt > 0),
touch AS (SELECT c.symbol, c.rn,
  min(CASE WHEN (c.side > 0 AND p.high >= c.tp) OR (c.side < 0 AND p.low <= c.tp) THEN p.rn - c.rn END) AS t,
  min(CASE WHEN (c.side > 0 AND p.low <= c.sl) OR (c.side < 0 AND p.high >= c.sl) THEN p.rn - c.rn END) AS s
  FROM cand c JOIN sided p ON p.symbol = c.symbol AND p.rn BETWEEN c.rn + 1 AND c.rn + 24 GROUP BY ALL),
judged AS (SELECT c.*, t, s, (s IS NOT NULL AND (t IS NULL OR s <= t)) AS stopped FROM cand c JOIN touch USING (symbol, rn)),
held AS (SELECT *, CASE WHEN stopped THEN s WHEN t IS NOT NULL THEN t ELSE 24 END AS held,
  CASE WHEN stopped THEN ln(1 - least(greatest(1.5::DOUBLE * trgt, 0), 1 - 1e-6))
    WHEN t IS NOT NULL THEN ln(1 + greatest(1.5::DOUBLE * trgt, 0))
    ELSE ln(1 + least(greatest(side * (ce / greatest(close, 1e-12) - 1), -1 + 1e-12), 1e6)) END AS ret FROM judged),
labels_all AS (SELECT h.symbol, h.t0, b.ts AS t1, h.side, h.trgt, h.close, h.ret, h.rn AS r0, h.rn + h.held AS r1,
  CASE WHEN stopped THEN 0 WHEN t IS NOT NULL THEN 1 ELSE (ret > 0)::INT END AS bin, held::INT AS bars_held
  FROM held h JOIN sided b ON b.symbol = h.symbol AND b.rn = h.rn + h.held)"""
LABELS = f"{BARS}, {ATR}, {SIDES}, {LABELLED}"
#: All labels, by the name that the statements on events read.
EVENTS = f"{LABELS}, ev AS (SELECT * FROM labels_all)"
#: What the hit-rate expert says of each event: wins among the last 20 labels of its symbol and side that had ended.
PROBS = """en AS (SELECT symbol, side, t1, t0, sum(bin) OVER x AS wins, count(*) OVER x AS n FROM ev WINDOW x AS (PARTITION BY symbol, side ORDER BY t1, t0 ROWS 19 PRECEDING)),
el AS (SELECT symbol, side, t1, arg_max(wins, t0) AS wins, arg_max(n, t0) AS n FROM en GROUP BY ALL),
pe AS (SELECT ev.*, round((coalesce(el.wins, 0) + 1) / (coalesce(el.n, 0) + 2), 4) AS prob, coalesce(el.n, 0) = 20 AS confident
  FROM ev ASOF LEFT JOIN el ON el.symbol = ev.symbol AND el.side = ev.side AND ev.t0 >= el.t1)"""
NEWS = """items AS (SELECT doc_id AS item_id, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 43200) AS published_at,
  string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body, source, (1 + doc_id % 4)::INT AS tier,
  ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS symbol FROM documents)"""
