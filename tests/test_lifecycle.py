"""Cross-fitting by label intervals, stored models, partitioned tables and the live loop."""

import datetime as dt
import glob
import math
import os
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from barflow.operators import crossfit, learning, lifecycle
from barflow.plans import streams
from barflow.sources import bars as source
from barflow.sources import tables
from barflow.streaming.live import Loop

START = dt.datetime(2024, 1, 1)
LOGISTIC = {"one": lambda: LogisticRegression(labelCol="bin", weightCol="w", regParam=0.1), "two": lambda: LogisticRegression(labelCol="bin", weightCol="w", regParam=10.0)}


def hour(k):
    return START + dt.timedelta(hours=k)


@pytest.fixture(scope="module")
def events(spark):
    """Labels of up to twelve hours whose class follows from a feature, with noise."""
    rng = random.Random(1)
    rows = []
    for s in ("a", "b"):
        for k in range(240):
            x = rng.gauss(0, 1)
            rows.append((s, hour(3 * k), hour(3 * k + rng.randint(1, 12)), x, rng.gauss(0, 1), int(rng.random() < 1 / (1 + math.exp(-2 * x))), 1.0, rng.uniform(-0.02, 0.03), rng.randint(1, 12)))
    df = spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, x double, z double, bin int, w double, ret double, bars_held int")
    return df.repartition(2).cache()


def test_no_train_label_meets_its_test_fold(events):
    scored = learning.out_of_fold(events, ["x", "z"], 4, LOGISTIC)
    wide = crossfit.widened(scored.withColumn("combo", F.lit(0)), ["one", "two"]).withColumn("outer", F.lit("train")).drop("fold")
    for dealt in (crossfit.deal(learning.one_combination(events, ["x", "z"]), 4, 0.02), crossfit.deal(wide, 4, 0.02)):
        rows = dealt.select("symbol", "t0", "t1", "fold", "part").collect()
        assert sum(r["part"] == "test" for r in rows) == 480
        for s in ("a", "b"):
            for fold in range(4):
                own = [r for r in rows if r["symbol"] == s and r["fold"] == fold]
                tests = [r for r in own if r["part"] == "test"]
                train = [r for r in own if r["part"] == "train"]
                assert len(tests) == 60 and 150 < len(train) < 180
                low, high = min(r["t0"] for r in tests), max(r["t1"] for r in tests)
                assert not any(r["t1"] >= low and r["t0"] <= high for r in train)


def test_stack_learns_from_other_folds(events):
    oof = learning.out_of_fold(events, ["x", "z"], 3, LOGISTIC)
    assert oof.groupBy("expert").count().collect()[0]["count"] == 480
    got = learning.stack(oof).collect()
    assert len(got) == 480 and not any(r["fallback"] for r in got)
    right = [(r["prob"] > 0.5) == (r["bin"] == 1) for r in got]
    assert 0.65 < sum(right) / len(right) < 0.95


def test_combinations_have_calibrators_of_their_own(events):
    judged, said = learning.evaluate_combinations(events, ["x", "z"], 3, 1, experts=LOGISTIC)
    rows = said.collect()
    assert {(r["combo"], r["expert"]) for r in rows} == {(c, e) for c in range(3) for e in ("one", "two", "ensemble")} and len(rows) == 18
    for r in rows:
        assert r["tag"] is None and r["n_fit"] + r["n_conformal"] == r["n_oof"] and r["n_conformal"] >= 20 and 0 < r["qhat"] <= 1
    assert len({round(r["qhat"], 6) for r in rows}) > 3
    test = judged.groupBy("symbol", "combo", "expert").agg(F.count("*").alias("n"), F.countDistinct("prob").alias("values")).collect()
    assert {r["n"] for r in test} == {80} and all(r["values"] > 2 for r in test)


def test_few_rows_stay_raw_and_say_so(events):
    few = events.filter((F.col("symbol") == "a") & (F.col("t0") < F.lit(hour(75))))
    judged, said = learning.evaluate_combinations(few, ["x", "z"], 3, 1, experts={"one": LOGISTIC["one"]})
    assert all("cpcv_cal_conformal_skipped" in r["tag"] for r in said.collect())
    assert all(r["confident"] for r in judged.collect())


def test_a_stored_version_scores_as_the_fitted_one(spark, events, tmp_path):
    early = events.filter(F.col("t1") < F.lit(hour(500)))
    fitted = lifecycle.fit(early, ["x", "z"], LOGISTIC)
    folder = str(tmp_path / "models")
    assert lifecycle.versions(spark, folder) == []
    lifecycle.save(fitted, folder, "v1")
    lifecycle.save(fitted, folder, "v1")
    os.makedirs(f"{folder}/v2/experts")  # a version that was not finished
    assert lifecycle.versions(spark, folder) == ["v1"]
    loaded = lifecycle.load(spark, folder)
    assert (loaded.version, loaded.n_rows, loaded.columns) == ("v1", early.count(), ["x", "z"])
    later = events.filter(F.col("t0") >= F.lit(hour(500))).select("symbol", "t0", "x", "z", "bin")
    key = lambda df: sorted((r["symbol"], r["t0"], r["prob"], r["confident"], r["tag"]) for r in df.collect())
    got = key(lifecycle.score(loaded, later))
    assert got == key(lifecycle.score(fitted, later)) and len(got) == later.count()
    truth = {(r["symbol"], r["t0"]): r["bin"] for r in later.collect()}
    assert sum((p > 0.5) == (truth[s, t] == 1) for s, t, p, _, _ in got) / len(got) > 0.65
    with pytest.raises(ValueError):
        lifecycle.load(spark, folder, "v2")


def test_rows_and_schemas_that_lack_features(spark, events, tmp_path):
    fitted = lifecycle.fit(events, ["x", "z"], {"one": LOGISTIC["one"]})
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("a", None, 0.0), ("new", 1.0, 0.0)], "symbol string, x double, z double").withColumn("prediction", F.lit("kept"))
    got = {(r["symbol"], r["x"]): r for r in lifecycle.score(fitted, rows).collect()}
    assert got["a", None]["prob"] is None and not got["a", None]["confident"] and got["a", None]["tag"] == "feature_missing"
    assert got["new", 1.0]["tag"] == "not_calibrated" and got["new", 1.0]["confident"] and got["a", 1.0]["prob"] > 0.5
    assert all(r["prediction"] == "kept" for r in got.values())
    held = lifecycle.score(fitted, rows.drop("z")).collect()
    assert len(held) == 3 and all(r["prob"] is None and r["tag"] == "feature_schema_mismatch(z)" for r in held)
    assert lifecycle.fit(events.withColumn("bin", F.lit(1)), ["x", "z"], LOGISTIC) is None


def test_the_head_and_its_scale_see_train_rows_only(events):
    """Other values in some test rows of a fold change nothing for the rest of that fold, scale included."""
    head = {"fusion": learning.fusion_head}
    dealt = crossfit.deal(learning.one_combination(events, ["x", "z"]), 3, 0.01).filter("fold = 1")
    odd = (F.col("part") == "test") & (F.hour("t0") % 2 == 0)
    changed = dealt.withColumn("features", F.when(odd, crossfit.array_to_vector(F.array(F.lit(1e6), F.lit(-1e6)))).otherwise(F.col("features")))
    rows = [{(r["symbol"], r["t0"]): r["prob"] for r in crossfit.fit_units(d, learning.made(head))[0].collect()} for d in (dealt, changed)]
    assert len(rows[0]) == 160
    for key, prob in rows[0].items():
        assert (prob == pytest.approx(rows[1][key], rel=1e-9)) == (key[1].hour % 2 == 1)


def test_permutations_keep_counts_and_seed_zero_keeps_labels(spark, events):
    rows = events.withColumn("side", F.lit(1.0)).select("symbol", "t0", "t1", "side", "bin")
    got = learning.permuted(rows, 3).collect()
    truth = {(r["symbol"], r["t0"]): r["bin"] for r in rows.collect()}
    assert len(got) == 4 * len(truth)
    for seed in range(4):
        own = {(r["symbol"].split("|")[0], r["t0"]): r["bin"] for r in got if r["seed"] == seed}
        assert sum(own.values()) == sum(truth.values()) and (own == truth) == (seed == 0)


def ticks(spark, rows):
    return spark.createDataFrame([(s, hour(k) + dt.timedelta(minutes=m), i, float(p)) for s, k, m, i, p in rows], "symbol string, ts timestamp_ntz, tick_id long, price double")


def test_new_ticks_rewrite_the_days_they_touch(spark, tmp_path):
    at, out = str(tmp_path / "ticks"), str(tmp_path / "bars")
    rng = random.Random(2)
    rows = [("s", k, rng.randint(0, 59), k, rng.uniform(1, 9)) for k in range(24 * 5)]
    late = [r for r in rows if r[1] % 7 == 3 and r[1] < 72]
    assert len(tables.merge_ticks(ticks(spark, [r for r in rows if r not in late]), at, out)) == 5
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{out}/day=*/*.parquet")}
    for _ in range(2):  # the second time changes nothing
        assert [d.day for d in tables.merge_ticks(ticks(spark, late), at, out)] == [1, 2, 3]
        left = {f for f in glob.glob(f"{out}/day=2024-01-0[45]/*.parquet")}
        assert left and all(before[f] == os.stat(f).st_mtime_ns for f in left)
        whole = source.bars_from_ticks(ticks(spark, rows))
        names = whole.columns
        assert sorted(map(tuple, spark.read.parquet(out).select(names).collect())) == sorted(map(tuple, whole.collect()))
    plan = tables.read_days(spark, at, [dt.date(2024, 1, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan
    assert tables.merge_ticks(ticks(spark, []), at, out) == []


def test_a_batch_that_runs_again_leaves_each_decision_once(spark, tmp_path):
    """The last batch is taken back from the checkpoint, as a driver lost before its commit would leave it, and the loop goes on."""
    rng = random.Random(3)
    rows, price = [], 100.0
    for k in range(24 * 12):
        price *= math.exp(rng.gauss(0, 0.02))
        rows.append(("s", k, rng.randint(0, 59), k, price))
    place = str(tmp_path / "in")
    os.makedirs(place)
    for k in range(3):
        ticks(spark, rows[k * 96 : (k + 1) * 96]).coalesce(1).write.mode("append").parquet(place)

    def features(bars):
        past = F.col("close") / F.lag("close", 3).over(source.Window.partitionBy("symbol").orderBy("ts")) - 1
        return bars.withColumns({"x": past, "side": F.when(past >= 0, 1.0).when(past < 0, -1.0), "trgt": F.lit(0.02), "event": F.lit(True)})

    def labelled(df):
        w = source.Window.partitionBy("symbol").orderBy("ts")
        out = df.withColumns({"t1": F.lead("ts", 4).over(w), "bin": (F.lead("close", 4).over(w) > F.col("close")).cast("int"), "w": F.lit(1.0)})
        return out.filter("x is not null and t1 is not null").withColumnRenamed("ts", "t0")

    loop = Loop(str(tmp_path / "loop"), features, labelled, ["x"], streams.trading.RULES, {"one": LOGISTIC["one"]}, retrain_every=2)
    stream = spark.readStream.schema("symbol string, ts timestamp_ntz, tick_id long, price double").option("maxFilesPerTrigger", 1).parquet(place)
    loop.run(stream)
    got = sorted(map(tuple, loop.decisions(spark).collect()), key=str)
    assert [r[-1] for r in sorted(got, key=lambda r: r[-1])] == [0, 1, 2]
    made = {r["batch"]: r for r in loop.decisions(spark).collect()}
    assert [made[k]["version"] for k in range(3)] == ["v0000000000", "v0000000000", "v0000000002"]
    assert [made[k]["ts"] for k in range(3)] == [hour(94), hour(190), hour(286)]
    assert made[1]["last_signal"] == made[0]["signal"] and made[0]["last_signal"] is None
    stamp = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{loop.folder}/models/v*/manifest/*.parquet")}
    for f in ("2", ".2.crc"):
        os.unlink(f"{loop.folder}/checkpoint/commits/{f}")
    loop.run(stream)
    assert sorted(map(tuple, loop.decisions(spark).collect()), key=str) == got
    assert stamp == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{loop.folder}/models/v*/manifest/*.parquet")}
    bars = source.bars_from_ticks(ticks(spark, rows))
    assert sorted(map(tuple, spark.read.parquet(loop.place("bars")).select(bars.columns).collect())) == sorted(map(tuple, bars.collect()))
