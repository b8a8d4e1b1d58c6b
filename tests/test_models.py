import math

import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from wattframe.operators.outlook import with_fallback, forecast_distance, scaled
from wattframe.plans import forecast as fc
from wattframe.plans import models as mod
from wattframe.plans.jobs import get_model, train_job
from wattframe.schema import FEATURES
from wattframe.sources import read_run

SMALL = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "linear": {}}


def wave(n, level):
    return [level + 4 * math.sin(i * 2 * math.pi / 7) + (i * 37 % 11) / 10 for i in range(n)]


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(m, i, v) for m, level, n in (("a", 20, 150), ("b", 400, 120)) for i, v in enumerate(wave(n, level))]
    return spark.createDataFrame(rows, "meter_id STRING, i INT, kwh DOUBLE").selectExpr(
        "meter_id", "date_add(date'2024-01-01', i) AS day", "kwh"
    ).cache()


@pytest.fixture(scope="module")
def run(daily):
    return mod.benchmark(daily, SMALL)


def test_benchmark(run):
    rows = {r["model"]: r for r in run.metrics.collect()}
    assert set(rows) == set(SMALL) and rows["linear"]["r2"] > 0.9
    assert run.best == min(SMALL, key=lambda n: rows[n]["rmse"])
    assert rows["linear"]["n"] == 24 + 18


def test_importances(run):
    rows = run.importances.where("model = 'random_forest'").orderBy("rank").collect()
    assert len(rows) == 36 and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert mod.top_features(run.importances, 12).count() == 12


def test_scaling_is_fitted_on_train_rows(run, daily):
    b = {r["meter_id"]: r for r in run.bounds.collect()}
    f = run.frame.where("split = 'train'").groupBy("meter_id").agg(F.min("kwh").alias("lo"), F.max("kwh").alias("hi")).collect()
    for r in f:
        assert (b[r["meter_id"]]["lo"], b[r["meter_id"]]["hi"]) == (r["lo"], r["hi"])


@pytest.mark.parametrize("h", [7, 14])
def test_forecast(run, daily, h):
    got = fc.forecast(run.models["linear"], daily, h, run.bounds, "linear").orderBy("meter_id", "step").collect()
    assert len(got) == 2 * h and str(got[0]["day"]) == "2024-05-30" and str(got[h]["day"]) == "2024-04-30"
    assert all(r["forecast_kwh"] >= 0 for r in got)
    truth = wave(150 + h, 20)[150:]
    assert max(abs(r["forecast_kwh"] - t) for r, t in zip(got[:h], truth)) < 3.0


def test_step_features_equal_training_features(spark, daily, run):
    """The features built from the buffer are those the windows build."""
    from wattframe.operators.baselines import history_buffer
    from wattframe.operators.features import engineer_features

    last = daily.groupBy("meter_id").agg(F.max("day").alias("d"))
    want = engineer_features(daily).join(last, "meter_id").where("date = d").orderBy("meter_id")
    cut = daily.join(last, "meter_id").where("day < d").drop("d")
    state = history_buffer(cut, 30).withColumn("fc", F.array().cast("array<double>"))
    for p in fc.step_projections():
        state = state.withColumns(p)
    for w, g in zip(want.collect(), state.orderBy("meter_id").collect()):
        for c in FEATURES:
            assert g[c] == pytest.approx(w[c]), c


def test_short_history(run, spark, series):
    d = series({"a": [3.0], "b": [1, 2, 3, 4, 5]})
    bounds = spark.createDataFrame([("a", 0.0, 5.0), ("b", 0.0, 5.0)], "meter_id STRING, lo DOUBLE, hi DOUBLE")
    assert fc.forecast(run.models["random_forest"], d, 3, bounds).count() == 6


def test_checkpoints_do_not_change_the_result(run, daily):
    a = fc.forecast(run.models["linear"], daily, 5, run.bounds, checkpoint_every=2)
    b = fc.forecast(run.models["linear"], daily, 5, run.bounds, checkpoint_every=99)
    assert sum(r["distance_kwh"] for r in forecast_distance(a, b).collect()) == 0.0


def test_models_disagree(run, daily):
    a = fc.forecast(run.models["linear"], daily, 7, run.bounds)
    b = fc.forecast(run.models["random_forest"], daily, 7, run.bounds)
    assert all(r["distance_kwh"] > 0.1 for r in forecast_distance(a, b).collect())


def test_more_load_raises_the_forecast(daily):
    one = daily.where("meter_id = 'a'")
    run = mod.benchmark(one, {"random_forest": SMALL["random_forest"]}, scale=False)
    plain = fc.forecast(run.best_fit, one, 5).agg(F.sum("forecast_kwh")).first()[0]
    more = scaled(one, [1.5]).drop("scenario")
    assert fc.forecast(run.best_fit, more, 5).agg(F.sum("forecast_kwh")).first()[0] > plain


def test_any_estimator_fits(daily):
    frame = mod.training_frame(daily)
    est = DecisionTreeRegressor(maxDepth=3, featuresCol="features", labelCol="target", predictionCol="prediction")
    assert mod.score_test(mod.fit(frame, est), frame).where("prediction < 0").count() == 0


def test_sequence_model(daily):
    frame, bounds = fc.sequence_frame(daily, 14)
    assert frame.where("split = 'test'").count() == 30 + 24
    got = fc.forecast_sequence(fc.fit_sequence(frame), daily, bounds, 14, 7).orderBy("meter_id", "step").collect()
    truth = wave(157, 20)[150:]
    assert len(got) == 14 and max(abs(r["forecast_kwh"] - t) for r, t in zip(got[:7], truth)) < 3.0


def test_job_publishes_and_is_found(spark, daily, tmp_path):
    out = str(tmp_path / "reg")
    train_job(daily, out, {"linear": {}}, horizon=3)
    assert read_run(spark, out, "metrics").count() == 1 and read_run(spark, out, "summary").count() == 2
    found = get_model(spark, out, "linear")
    assert found.name == "linear"
    a = fc.forecast(found.model, daily, 3, found.bounds).select("meter_id", "day", "forecast_kwh")
    assert a.exceptAll(read_run(spark, out, "forecast").select("meter_id", "day", "forecast_kwh")).count() == 0
    assert get_model(spark, out, "no such name").name == "best"
    with pytest.raises(FileNotFoundError):
        get_model(spark, str(tmp_path / "empty"), "linear")
    trained = get_model(spark, str(tmp_path / "empty"), "linear", daily)
    assert trained.name == "linear" and trained.bounds.count() == 2


def test_published_settings():
    rf, gbt, wide = (mod.candidate(n) for n in ("random_forest", "gbt", "gbt_wide"))
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getSeed()) == (200, 12, 42)
    assert (gbt.getMaxIter(), gbt.getStepSize(), gbt.getMaxDepth(), gbt.getSubsamplingRate()) == (150, 0.05, 4, 0.85)
    assert (wide.getMaxIter(), wide.getStepSize(), wide.getSubsamplingRate(), wide.getFeatureSubsetStrategy()) == (200, 0.04, 0.8, "0.8")


def test_no_meter_is_lost_or_crashes_for_being_short(spark, series):
    sizes = (1, 10, 30, 31, 32, 120)
    d = series({f"m{n}": [10 + (i * 7 + n) % 5 for i in range(n)] for n in sizes})
    run = mod.benchmark(d, {"linear": {}})
    out = fc.forecast(run.best_fit, d, 3, run.bounds, "linear").collect()
    assert sorted((r["meter_id"], r["step"]) for r in out) == sorted((f"m{n}", k) for n in sizes for k in (1, 2, 3))
    assert all(r["forecast_kwh"] is not None and r["forecast_kwh"] >= 0 for r in out)
    frame, bounds = fc.sequence_frame(d, 7)
    seq = fc.forecast_sequence(fc.fit_sequence(frame), d, bounds, 7, 3).collect()
    assert len(seq) == 3 * len(sizes) and all(r["forecast_kwh"] is not None for r in seq)


def test_scenarios_share_the_bounds_of_their_meter(spark, series):
    d = series({"a": [10 + i % 7 for i in range(120)]})
    run = mod.benchmark(d, {"linear": {}})
    cases = d.selectExpr("*", "explode(array('low', 'high')) AS scenario").selectExpr("meter_id", "scenario", "day", "kwh * if(scenario = 'low', 0.9, 1.1) AS kwh")
    out = fc.forecast(run.best_fit, cases, 2, run.bounds, "linear", key=["meter_id", "scenario"]).collect()
    assert sorted((r["scenario"], r["step"]) for r in out) == [("high", 1), ("high", 2), ("low", 1), ("low", 2)]


def test_every_meter_has_its_own_look_back(spark, series):
    """Meters of 40 and of 400 days: ragged windows, one model for each length, one rollout."""
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"short": rng.uniform(5, 9, 40).tolist(), "long": rng.uniform(50, 90, 400).tolist(), "flat": [4.0] * 40, "tiny": [1.0, 2.0, 3.0]}
    d = series(values)
    frame = fc.lookback_frame(d, 30)
    size = {(r.meter_id, r.lookback, r.n) for r in frame.select("meter_id", "lookback", F.size("inputs").alias("n")).distinct().collect()}
    assert size == {("short", 7, 7), ("flat", 7, 7), ("long", 30, 30)}
    frame = fc.lookback_frame(d, 30, features=fc.window_mean)
    fitted = fc.fit_lookbacks(frame, mod.CANDIDATES["linear"](regParam=0.0, solver="normal"))
    assert sorted(fitted.models) == [7, 30]
    got = fc.forecast_lookbacks(fitted, d, 6, features=fc.window_mean)
    v, n = np.array(values["long"]), 320
    lo, hi = v[:n].min(), v[:n].max()
    z = (v - lo) / (hi - lo)
    x = np.array([z[i - 30 : i].mean() for i in range(30, n)])
    b, a = np.polyfit(x, z[30:n], 1)
    buf = z[-30:].tolist()
    for _ in range(6):
        buf.append(a + b * np.mean(buf[-30:]))
    want = [round(max(0.0, y * (hi - lo) + lo), 2) for y in buf[30:]]
    rows = {m: [r.forecast_kwh for r in got.where(f"meter_id = '{m}'").orderBy("step").collect()] for m in values}
    assert rows["long"] == pytest.approx(want, abs=0.02) and len(rows["short"]) == len(rows["flat"]) == 6 and rows["tiny"] == []
    summary = {r.meter_id: r for r in with_fallback(got, d, 6).collect()}
    assert {m: r.kind for m, r in summary.items()} == {"short": "model", "long": "model", "flat": "model", "tiny": "history"}
    assert summary["tiny"].expected_avg_kwh == 2.0 and summary["tiny"].total_expected_kwh == 12.0 and summary["tiny"].max_forecast_date is None
