import pytest
from pyspark.sql import functions as F

from wattframe.functions.numeric import clip0, min_max, min_max_inverse, pct_change
from wattframe.operators import metrics as m
from wattframe.operators import outlook as o
from wattframe.operators import reports as r
from wattframe.operators.baselines import baseline_ma, baseline_persistence, forecast_baseline, history_buffer
from wattframe.operators.savings import savings
from wattframe.operators.split import split_chrono


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_profile_has_24_hours_and_nulls_where_nothing_was_read(spark):
    df = spark.sql(
        "SELECT 'a' AS meter_id, timestamp'2024-01-01 05:10:00' AS ts, 2.0D AS active_power_kw, 1D AS sub1_wh, 2D AS sub2_wh, 3D AS sub3_wh"
        " UNION ALL SELECT 'a', timestamp'2024-01-02 05:20:00', 4.0D, 1D, 2D, 3D UNION ALL SELECT 'a', timestamp'2024-01-02 06:20:00', null, 1D, 2D, 3D"
    )
    rows = {x["hour"]: x for x in r.hourly_profile(df).collect()}
    assert sorted(rows) == list(range(24)) and rows[5]["mean_power_kw"] == 3.0 and rows[5]["hour_label"] == "05:00"
    assert rows[6]["mean_power_kw"] is None and rows[5]["std_power_kw"] == 1.414


def test_peak_hours_of_a_profile(spark):
    mean = [0.5 + (h % 12) / 10 for h in range(24)]
    mean[4], mean[19] = 0.3, 2.1
    rows = list(zip(["a"] * 24, range(24), mean, [0.8] * 24))
    df = spark.createDataFrame(rows, "meter_id STRING, hour INT, mean_power_kw DOUBLE, std_power_kw DOUBLE")
    x = one(r.peak_hours(df))
    assert (x["peak_hour_label"], x["peak_hour_power_kw"], x["min_hour_label"], x["min_hour_power_kw"]) == ("19:00", 2.1, "04:00", 0.3)
    assert r.profile_envelope(df).where("lower_kw < 0").count() == 0
    assert r.load_zones(df).agg(F.sum("hours")).first()[0] == 24


def test_earlier_hour_wins_a_tie(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 7, 1.0)], "meter_id STRING, hour INT, mean_power_kw DOUBLE")
    x = one(r.peak_hours(df))
    assert (x["peak_hour"], x["min_hour"]) == (3, 3)


def test_first_day_wins_a_tie(series):
    d = series({"a": [1, 9, 9, 2]})
    assert str(one(r.kpis(d))["max_date"]) == "2024-01-02"
    assert [x["rank"] for x in r.top_peak_days(d, 2).orderBy("day").collect()] == [1, 2]


def test_constant_series(series, spark):
    d = series({"a": [5, 5, 5]})
    h = one(r.histogram(d))
    assert (h["bin"], h["days"], h["median"]) == (1, 3, 5.0)
    scaled = spark.sql("SELECT 5D AS y, 5D AS lo, 5D AS hi").select(min_max("y", "lo", "hi").alias("z"), min_max_inverse(F.lit(0.0), "lo", "hi").alias("y"))
    assert tuple(one(scaled)) == (0.0, 5.0)


def test_histogram_maximum_is_in_the_last_bin(series):
    rows = r.histogram(series({"a": range(81)})).collect()
    assert max(x["bin"] for x in rows) == 40 and sum(x["days"] for x in rows) == 81


def test_percent_change_floor(spark):
    x = one(spark.sql("SELECT 2D AS a, 0D AS b").select(pct_change("a", "b").alias("p"), clip0(F.lit(-1.0)).alias("c"), clip0(F.lit(None).cast("double")).alias("n")))
    assert (x["p"], x["c"], x["n"]) == (pytest.approx(200000.0), 0.0, None)


def test_no_hot_day_gives_null(series):
    d = series({"a": [1, 2]}).withColumn("Temperature", F.lit(20.0))
    x = one(r.temperature_effect(d))
    assert x["hot_mean"] is None and x["mild_mean"] == 1.5 and x["diff_pct"] is None
    assert r.temperature_effect(series({"a": [1]})) is None and r.occupancy_box(series({"a": [1]})) is None


def test_outliers(series):
    out = r.outliers(series({"a": [10, 11, 12, 10, 11, 12, 100]}), ["meter_id"]).collect()
    assert [x["kwh"] for x in out] == [100.0]


def test_error_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 5.0), ("b", 4.0, 4.0)], "k STRING, y DOUBLE, p DOUBLE")
    got = {x["k"]: x for x in m.error_metrics(df, "y", "p", ["k"]).collect()}
    a = got["a"]
    assert a["mae"] == pytest.approx(1.0) and a["rmse"] == pytest.approx((5 / 3) ** 0.5)
    assert a["r2"] == pytest.approx(1 - 5 / 2) and a["mape"] == pytest.approx((1 + 0 + 2 / 3) / 3 * 100)
    assert got["b"]["r2"] is None


def test_best_model_has_the_least_rmse(spark):
    rows = [("Random Forest", 0, 4.2, 5.7, 0.41, 20.2), ("Boosting", 1, 4.1, 5.8, 0.39, 19.1), ("Wide boosting", 2, 4.1, 5.75, 0.4, 18.9)]
    df = spark.createDataFrame(rows, "model STRING, candidate_no INT, mae DOUBLE, rmse DOUBLE, r2 DOUBLE, mape DOUBLE")
    assert one(m.best_model(df))["model"] == "Random Forest"
    tie = spark.createDataFrame([("x", 1, 2.0), ("y", 0, 2.0)], "model STRING, candidate_no INT, rmse DOUBLE")
    assert one(m.best_model(tie))["model"] == "y"


def test_savings_of_the_published_mean(series):
    x = one(savings(series({"a": [26.15]})))
    annual = 26.15 * 365
    assert x["annual_kwh"] == pytest.approx(annual) and x["saved_money"] == pytest.approx(annual * 0.15 * 0.18)
    assert x["trees"] == int(annual * 0.15 * 0.42 / 21.7)
    assert savings(series({"a": [1], "b": [2]}), [(0.1, 10, 0.4), (0.2, 20, 0.4)]).count() == 4


def test_baselines_on_test_rows_only(series):
    split = split_chrono(series({"a": range(1, 21)}))
    p = baseline_persistence(split).orderBy("day").collect()
    assert [(x["kwh"], x["prediction"]) for x in p] == [(17, 16), (18, 17), (19, 18), (20, 19)]
    ma = baseline_ma(split).orderBy("day").collect()
    assert [x["prediction"] for x in ma] == [13, 14, 15, 16]


@pytest.mark.parametrize("h", [7, 14, 30])
def test_rollout_dates_are_contiguous(series, h):
    fc = forecast_baseline(series({"a": [1, 2, 3], "b": [5] * 40}), "ma", h).orderBy("meter_id", "step").collect()
    assert len(fc) == 2 * h
    assert str(fc[0]["day"]) == "2024-01-04" and (fc[h - 1]["day"] - fc[0]["day"]).days == h - 1
    assert fc[0]["forecast_kwh"] == 2.0 and fc[1]["forecast_kwh"] == pytest.approx((1 + 2 + 3 + 2) / 4)
    assert all(x["forecast_kwh"] == 5.0 for x in fc[h:])


def test_buffer_is_short_and_ordered(series):
    b = one(history_buffer(series({"a": range(100)}), 30))
    assert list(b["buf"]) == list(range(70, 100)) and str(b["last_day"]) == "2024-04-09"


def test_summary_peak_is_the_highest_forecast(series):
    fc = o.finish_forecast(forecast_baseline(series({"a": [1, 2, 3, 4, 5, 6, 10]}), "ma", 14))
    x, rows = one(o.forecast_summary(fc)), fc.collect()
    assert x["max_forecast_kwh"] == max(y["forecast_kwh"] for y in rows) and x["horizon_days"] == 14
    first = min(y["day"] for y in rows if y["forecast_kwh"] == x["max_forecast_kwh"])
    assert x["max_forecast_date"] == first.strftime("%Y-%m-%d (%a)")


def test_forecast_of_weekdays_only_takes_the_overall_mean(series):
    fc = o.finish_forecast(forecast_baseline(series({"a": [4.0]}, "2024-01-07"), "persistence", 3))
    x = one(o.forecast_weekend_effect(fc))
    assert (x["weekend_mean"], x["weekday_mean"]) == (4.0, 4.0)


def test_autocorrelation_of_a_weekly_pattern(series):
    x = one(r.autocorr(series({"a": [1, 2, 3, 4, 5, 9, 8] * 6})))
    assert x["autocorr"] == pytest.approx(1.0) and x["pairs"] == 35
