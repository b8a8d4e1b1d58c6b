import pytest
from pyspark.sql import functions as F

from wattframe.catalog.standins import QUESTIONS
from wattframe.operators import assistant as a
from wattframe.operators.baselines import forecast_baseline
from wattframe.operators.outlook import finish_forecast

INTENTS = [
    "greeting", "forecast", "peak", "weekend", "historical", "model", "features", "schedule", "savings", "weather", "submetering",
    "fallback",
]


def route(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    return [r["intent"] for r in a.route_intents(df).orderBy("id").collect()]


def test_known_questions(spark):
    assert route(spark, QUESTIONS) == INTENTS


@pytest.mark.parametrize(
    "text, intent",
    [("  PEAK?  ", "peak"), ("speak", "fallback"), ("", "fallback"), ("épeak", "fallback"), ("model peak", "model"), ("hi", "greeting"), ("this", "fallback")],
)
def test_word_bounds_and_priority(spark, text, intent):
    assert route(spark, [text]) == [intent]


def test_answers_carry_only_what_the_intent_asks(spark, series):
    d = series({"a": [float(10 + i % 7) for i in range(60)]})
    f = a.facts(d, finish_forecast(forecast_baseline(d, "ma", 30)))
    q = spark.createDataFrame([("a", "save money"), ("a", "weekend"), ("a", "zzz"), ("none", "weekend")], "meter_id STRING, text STRING")
    got = {(r["meter_id"], r["intent"]): r["answer"] for r in a.answer(a.route_intents(q), f).collect()}
    assert '"saved_kwh"' in got[("a", "savings")] and "weekend" not in got[("a", "savings")]
    assert '"weekend_mean"' in got[("a", "weekend")] and '"mean_kwh"' in got[("a", "fallback")]
    assert got[("none", "weekend")] is None


def test_facts_with_models(spark, series):
    d = series({"a": range(1, 41), "b": range(2, 42)})
    metrics = spark.createDataFrame([("rf", 0, 1.0, 2.0, 0.5, 9.0), ("gbt", 1, 0.9, 2.1, 0.4, 8.0)], "model STRING, candidate_no INT, mae DOUBLE, rmse DOUBLE, r2 DOUBLE, mape DOUBLE")
    imps = spark.createDataFrame([("rf", f"f{i}", 1.0 / i, i) for i in range(1, 12)], "model STRING, feature STRING, importance DOUBLE, rank INT")
    rows = a.facts(d, metrics=metrics, importances=imps).collect()
    assert len(rows) == 2 and all(r["best_model"]["model"] == "rf" for r in rows)
    assert [t["feature"] for t in rows[0]["top_features"]["rf"]] == [f"f{i}" for i in range(1, 9)]
    assert a.facts(d).where("mean_kwh is null").count() == 0


def test_insights(series):
    d = series({"a": range(1, 41)})
    f = a.facts(d, finish_forecast(forecast_baseline(d, "ma", 30)))
    got = {r["insight"]: r for r in a.insights(f).collect()}
    assert set(got) == {"peak_surge", "weekend_pattern"}
    assert got["peak_surge"]["change_pct"] == pytest.approx((got["peak_surge"]["value"] - 20.5) / 20.5 * 100)
    sub = d.withColumns({f"sub{i}_wh": F.lit(100.0) for i in (1, 2, 3)})
    assert "thermal_base_load" in {r["insight"] for r in a.insights(a.facts(sub)).collect()}
