"""Queries over signals, labels, weights and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.functions import windows as W
from barflow.functions.windows import rounded
from barflow.operators import ewm, labels, learning, metrics, validation
from barflow.plans import sql
from barflow.plans.features import shown
from barflow.plans.registry import query
from barflow.sources import bars as source
from barflow.stored import stored


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return panel_of(source.hourly(spark, folder))


def panel_of(bars: DataFrame) -> DataFrame:
    """Hourly bars with ATR, momentum side and barrier target."""
    bars = ewm.atr(bars, 14, "atr_14")
    return labels.barrier_target(bars.withColumn("side", labels.momentum_side(F.col("close"), 24)))


def all_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.first_touch(panel(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with the hit-rate expert's probability."""
    return learning.hit_rate(all_labels(spark, folder))


@query(f"""WITH {sql.BARS} SELECT symbol, ts, CASE WHEN close / lag(close, 24) OVER w - 1 >= 0 THEN 1 WHEN close / lag(close, 24) OVER w - 1 < 0 THEN -1 END::DOUBLE AS side FROM bars {sql.W}""")
def primary_signal_momentum(spark: SparkSession, folder: str) -> DataFrame:
    return source.hourly(spark, folder).select("symbol", "ts", labels.momentum_side(F.col("close"), 24).alias("side"))


@query(f"""WITH {sql.BARS}, m AS (SELECT *, {sql.rolling('avg', 'close', 24)} AS ma FROM bars)
SELECT symbol, ts, CASE WHEN close >= ma THEN -1 WHEN close < ma THEN 1 END::DOUBLE AS side FROM m""")
def primary_signal_meanrev(spark: SparkSession, folder: str) -> DataFrame:
    return source.hourly(spark, folder).select("symbol", "ts", labels.reversal_side(F.col("close"), 24).alias("side"))


_THRESHOLD = """th AS (SELECT *, coalesce(CASE WHEN count(trgt) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) >= 50
  THEN quantile_cont(trgt, 0.5) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) END, 0.005) AS threshold FROM sided)"""


@query(f"WITH {sql.BARS}, {sql.ATR}, {sql.SIDES}, {_THRESHOLD} SELECT symbol, ts, round(threshold, 6) + 0 AS threshold FROM th")
def expanding_median_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return shown(labels.cusum_threshold(panel(spark, folder)), "threshold")


_CUSUM = f"""WITH RECURSIVE {sql.BARS}, {sql.ATR}, {sql.SIDES}, {_THRESHOLD},
x AS (SELECT symbol, ts, rn, threshold AS thr, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS d FROM th {sql.W}),
c AS (SELECT symbol, ts, rn, 0::DOUBLE AS up, 0::DOUBLE AS down, false AS hit FROM x WHERE rn = 1
  UNION ALL SELECT symbol, ts, rn, CASE WHEN NOT fell AND u > thr THEN 0 ELSE u END, CASE WHEN fell THEN 0 ELSE v END, fell OR u > thr FROM (
    SELECT x.symbol, x.ts, x.rn, thr, greatest(0, up + d) AS u, least(0, down + d) AS v, least(0, down + d) < -thr AS fell
    FROM c JOIN x ON x.symbol = c.symbol AND x.rn = c.rn + 1))"""


@query(f"{_CUSUM} SELECT symbol, ts FROM c WHERE hit")
def cusum_events(spark: SparkSession, folder: str) -> DataFrame:
    return labels.cusum_events(labels.cusum_threshold(panel(spark, folder)), F.col("threshold"))


@query(f"""{_CUSUM}, n AS (SELECT symbol, count(*) FILTER (hit) AS n FROM c GROUP BY symbol)
SELECT c.symbol, count(*) FILTER (CASE WHEN n < 400 THEN rn > 24 ELSE hit END) AS n_events, bool_or(n < 400) AS full_sampling FROM c JOIN n USING (symbol) GROUP BY c.symbol""")
def event_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """CUSUM events, or every bar where a symbol has too few of them."""
    bars = stored(labels.cusum_threshold(panel(spark, folder)))
    times = labels.event_times(bars, F.col("threshold"), min_events=400)
    return times.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_events"), F.max("full_sampling").alias("full_sampling"))


@query(f"""{_CUSUM}, {sql.LABELLED}, n AS (SELECT symbol, count(*) FILTER (hit) AS n FROM c GROUP BY symbol)
SELECT l.symbol, t0, t1, round(ret, 6) + 0 AS ret, bin, n < 50 AS full_sampling FROM labels_all l JOIN c ON c.symbol = l.symbol AND c.rn = l.r0 JOIN n ON n.symbol = l.symbol
WHERE CASE WHEN n < 50 THEN l.r0 > 24 ELSE hit END""")
def cusum_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the sampled events: CUSUM events, or every bar after the lookback where a symbol has too few."""
    bars = stored(labels.cusum_threshold(panel(spark, folder)))
    times = labels.event_times(bars, F.col("threshold"), min_events=50)
    found = labels.first_touch(bars).join(times.withColumnRenamed("ts", "t0"), ["symbol", "t0"])
    return found.select("symbol", "t0", "t1", rounded(F.col("ret")).alias("ret"), "bin", "full_sampling")


@query(f"WITH {sql.BARS} SELECT * FROM (SELECT symbol, ts, lead(ts, 24) OVER w AS t1 FROM bars {sql.W}) WHERE t1 IS NOT NULL")
def vertical_barrier(spark: SparkSession, folder: str) -> DataFrame:
    df = source.hourly(spark, folder).select("symbol", "ts", F.lead("ts", 24).over(W.series()).alias("t1"))
    return df.filter("t1 is not null")


@query(f"WITH {sql.LABELS} SELECT symbol, t0, t1, side, round(trgt, 6) + 0 AS trgt, round(ret, 6) + 0 AS ret, bin, bars_held FROM labels_all")
def triple_barrier_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = all_labels(spark, folder)
    return df.select("symbol", "t0", "t1", "side", rounded(F.col("trgt")).alias("trgt"), rounded(F.col("ret")).alias("ret"), "bin", "bars_held")


@query(f"""WITH {sql.LABELS} SELECT symbol, count(*) AS n_labels, round(avg(bin), 6) + 0 AS positive_rate, round(avg(ret), 6) + 0 AS mean_ret,
round(avg(bars_held), 6) + 0 AS mean_bars_held FROM labels_all GROUP BY symbol""")
def label_summary(spark: SparkSession, folder: str) -> DataFrame:
    return all_labels(spark, folder).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_labels"), rounded(F.avg("bin")).alias("positive_rate"), rounded(F.avg("ret")).alias("mean_ret"),
        rounded(F.avg("bars_held")).alias("mean_bars_held"),
    )


@query(f"""WITH {sql.EVENTS} SELECT s.symbol, s.ts, count(e.r0) AS concurrent FROM sided s LEFT JOIN ev e ON e.symbol = s.symbol AND s.rn BETWEEN e.r0 AND e.r1 GROUP BY ALL""")
def event_concurrency(spark: SparkSession, folder: str) -> DataFrame:
    return labels.concurrency(source.hourly(spark, folder), all_labels(spark, folder)).select("symbol", "ts", "concurrent")


_CONC = """cc AS (SELECT s.symbol, s.rn, count(e.r0) AS c FROM sided s JOIN ev e ON e.symbol = s.symbol AND s.rn BETWEEN e.r0 AND e.r1 GROUP BY ALL),
un AS (SELECT e.symbol, e.t0, e.t1, e.ret, avg(1.0::DOUBLE / c) AS uniq FROM ev e JOIN cc ON cc.symbol = e.symbol AND cc.rn BETWEEN e.r0 AND e.r1 GROUP BY ALL)"""


@query(f"WITH {sql.EVENTS}, {_CONC} SELECT symbol, t0, round(uniq, 6) + 0 AS uniq FROM un")
def avg_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    df = labels.uniqueness(source.hourly(spark, folder), all_labels(spark, folder))
    return shown(df, "uniq", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS}, {_CONC} SELECT symbol, t0, round(abs(ret) * uniq / (avg(abs(ret) * uniq) OVER (PARTITION BY symbol) + 1e-12), 6) + 0 AS w FROM un""")
def sample_weights(spark: SparkSession, folder: str) -> DataFrame:
    df = labels.return_weights(labels.uniqueness(source.hourly(spark, folder), all_labels(spark, folder)))
    return shown(df, "w", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS} SELECT symbol, t0, round(0.5 + 0.5 * (row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1)
/ greatest(count(*) OVER (PARTITION BY symbol) - 1, 1), 6) + 0 AS w_decay FROM ev""")
def time_decay(spark: SparkSession, folder: str) -> DataFrame:
    return shown(labels.time_decay(all_labels(spark, folder)), "w_decay", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS}, {_CONC}, r AS (SELECT symbol, t0, abs(ret) * uniq / (avg(abs(ret) * uniq) OVER (PARTITION BY symbol) + 1e-12)
  * (0.5 + 0.5 * (row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1) / greatest(count(*) OVER (PARTITION BY symbol) - 1, 1)) AS raw FROM un)
SELECT symbol, t0, round(raw / (avg(raw) OVER (PARTITION BY symbol) + 1e-12), 6) + 0 AS w FROM r""")
def combined_weights(spark: SparkSession, folder: str) -> DataFrame:
    """What learners are fitted with: return weight times time decay, of mean one."""
    df = labels.combined_weights(labels.uniqueness(source.hourly(spark, folder), all_labels(spark, folder)))
    return shown(df, "w", keys=("symbol", "t0"))


GROUPS = """gr AS (SELECT symbol, t0, t1, ntile({n}) OVER (PARTITION BY symbol ORDER BY t0, t1) - 1 AS grp FROM ev),
bo AS (SELECT symbol, grp AS fold, min(t0) AS a, max(t1) AS b, floor(any_value(n) * 0.02) AS emb FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM gr) GROUP BY ALL),
af AS (SELECT g.symbol, g.t0, b.fold, row_number() OVER (PARTITION BY g.symbol, b.fold ORDER BY g.t0) AS k FROM gr g JOIN bo b ON g.symbol = b.symbol AND g.t0 > b.b),
jd AS (SELECT g.symbol, b.fold, g.t0, g.t1, g.grp = b.fold AS test, g.t1 >= b.a AND g.t0 <= b.b AS pur, coalesce(af.k <= b.emb, false) AS emb
  FROM gr g JOIN bo b USING (symbol) LEFT JOIN af ON af.symbol = g.symbol AND af.fold = b.fold AND af.t0 = g.t0)"""


@query(f"""WITH {sql.EVENTS}, {GROUPS.format(n=5)} SELECT symbol, fold::INT AS fold, t0, CASE WHEN test THEN 'test' WHEN pur THEN 'purged' WHEN emb THEN 'embargoed' ELSE 'train' END AS part FROM jd""")
def purged_kfold_train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return validation.purged_folds(all_labels(spark, folder), 5, 0.02).select("symbol", "fold", "t0", "part")


@query(f"""WITH {sql.EVENTS}, {GROUPS.format(n=5)} SELECT symbol, fold::INT AS fold, count(*) FILTER (NOT test AND NOT pur AND emb) AS n_embargoed,
min(t0) FILTER (NOT test AND NOT pur AND emb) AS first_embargoed FROM jd GROUP BY ALL""")
def embargo_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = F.col("part") == "embargoed"
    return validation.purged_folds(all_labels(spark, folder), 5, 0.02).groupBy("symbol", "fold").agg(
        F.count(F.when(out, 1)).alias("n_embargoed"), F.min(F.when(out, F.col("t0"))).alias("first_embargoed")
    )


@query(f"""WITH {sql.EVENTS}, {GROUPS.format(n=6)}, pairs AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS combo FROM range(6) x(a), range(6) y(b) WHERE a < b),
m AS (SELECT symbol, combo, t0, bool_or(test) AS test, bool_or(pur OR emb) AS dropped FROM jd JOIN pairs ON fold = a OR fold = b GROUP BY ALL)
SELECT symbol, combo::INT AS combo, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test AND dropped) AS n_out, count(*) FILTER (NOT test AND NOT dropped) AS n_train FROM m GROUP BY ALL""")
def cpcv_combos(spark: SparkSession, folder: str) -> DataFrame:
    parts = validation.combinatorial_folds(all_labels(spark, folder), 6, 2, 0.02)
    n = lambda p: F.count(F.when(F.col("part") == p, 1)).alias(f"n_{p}")
    return parts.groupBy("symbol", "combo").agg(n("test"), n("out"), n("train"))


@query(f"""WITH {sql.EVENTS}, {GROUPS.format(n=5)}, hu AS (SELECT symbol, fold, min(t0) AS a, max(t1) AS b FROM jd WHERE test GROUP BY ALL)
SELECT jd.symbol, jd.fold::INT AS fold, count(*) FILTER (NOT test AND NOT pur AND NOT emb AND t1 >= a AND t0 <= b) AS n_overlaps,
  count(*) FILTER (NOT test AND t1 >= a AND t0 <= b) AS n_before_purge FROM jd JOIN hu ON hu.symbol = jd.symbol AND hu.fold = jd.fold GROUP BY ALL""")
def cv_overlap_count(spark: SparkSession, folder: str) -> DataFrame:
    return validation.overlaps(validation.purged_folds(all_labels(spark, folder), 5, 0.02))


@query(f"""WITH {sql.EVENTS}, o AS (SELECT symbol, t0, row_number() OVER (PARTITION BY symbol ORDER BY t0) AS p, floor(count(*) OVER (PARTITION BY symbol) * 0.05) AS s, max(t0) OVER (PARTITION BY symbol) AS last FROM ev)
SELECT a.symbol, a.t0, coalesce(b.t0, a.last) AS embargo_until FROM o a LEFT JOIN o b ON b.symbol = a.symbol AND b.p = a.p + a.s""")
def embargo_times(spark: SparkSession, folder: str) -> DataFrame:
    return validation.embargo_times(all_labels(spark, folder), 0.05)


@query(f"""WITH {sql.EVENTS}, {sql.PROBS} SELECT symbol, count(*) AS n, count(*) FILTER (bin IS NULL OR ret IS NULL) AS n_missing, round(avg(bin), 6) + 0 AS positive_rate,
count(*) FILTER (t1 < t0) AS n_reversed, stddev_pop(bars_held) = 0 AS constant_feature FROM pe GROUP BY symbol""")
def dataset_sanity(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder)
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bin").isNull() | F.col("ret").isNull(), 1)).alias("n_missing"),
        rounded(F.avg("bin")).alias("positive_rate"), F.count(F.when(F.col("t1") < F.col("t0"), 1)).alias("n_reversed"),
        (F.stddev_pop("bars_held") == 0).alias("constant_feature"),
    )


@query(f"""WITH {sql.EVENTS}, s AS (SELECT DISTINCT symbol, epoch_us(x) / 1e6 AS x FROM (SELECT symbol, t0 AS x FROM ev UNION ALL SELECT symbol, t1 FROM ev)),
g AS (SELECT symbol, x AS a, lead(x) OVER (PARTITION BY symbol ORDER BY x) AS b FROM s),
c AS (SELECT g.symbol, g.a, g.b, count(*) AS c FROM g JOIN ev e ON e.symbol = g.symbol AND epoch_us(e.t0) / 1e6 <= g.a AND epoch_us(e.t1) / 1e6 >= g.b GROUP BY ALL)
SELECT e.symbol, e.t0, round(sum((c.b - c.a) / c.c) / (any_value(epoch_us(e.t1) - epoch_us(e.t0)) / 1e6), 6) + 0 AS uniq FROM ev e
JOIN c ON c.symbol = e.symbol AND epoch_us(e.t0) / 1e6 <= c.a AND epoch_us(e.t1) / 1e6 >= c.b GROUP BY ALL""")
def time_weighted_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return shown(metrics.time_uniqueness(all_labels(spark, folder)), "uniq", keys=("symbol", "t0"))


@query(f"""WITH {sql.EVENTS}, {GROUPS.format(n=5)}, trn AS (SELECT symbol, fold, t0 FROM jd WHERE NOT (test OR pur OR emb)),
nx AS (SELECT g.symbol, b.fold, g.t0, row_number() OVER (PARTITION BY g.symbol, b.fold ORDER BY g.t0, g.t1) AS k, b.emb FROM gr g JOIN bo b ON g.symbol = b.symbol AND g.t0 > b.b)
SELECT nx.symbol, nx.fold::INT AS fold, count(*) AS n_banned, count(trn.t0) AS n_violations FROM nx LEFT JOIN trn ON trn.symbol = nx.symbol AND trn.fold = nx.fold AND trn.t0 = nx.t0
WHERE nx.k <= nx.emb GROUP BY ALL""")
def embargo_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each fold's embargo bans, and how many of them are train rows nevertheless."""
    events = stored(all_labels(spark, folder))
    folds = stored(validation.purged_folds(events, 5, 0.02))
    broken = validation.embargo_violations(events, folds, 5, 0.02).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n_violations"))
    banned = folds.filter("part = 'embargoed'").select("symbol", "fold", "t0").union(validation.embargo_violations(events, folds.withColumn("part", F.lit("train")), 5, 0.02)).distinct()
    out = banned.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n_banned")).join(broken, ["symbol", "fold"], "left")
    return out.select("symbol", "fold", "n_banned", F.coalesce("n_violations", F.lit(0)).alias("n_violations"))
