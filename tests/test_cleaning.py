import datetime as dt

import numpy as np
import pandas as pd
import pytest

from wattframe.operators import cleaning as c
from wattframe.operators.rollup import add_energy, day_spine, resample_daily

T0 = dt.datetime(2024, 1, 1)


def rows_of(values, meter="a", step=dt.timedelta(hours=5)):
    return [(meter, i, str(T0 + i * step), v) for i, v in enumerate(values)]


def filled(df):
    out = c.interpolate_linear(df, ["active_power_kw"]).orderBy("meter_id", "ts").collect()
    return [r["active_power_kw"] for r in out]


@pytest.mark.parametrize(
    "values, want",
    [
        ([None, 1.0, None, None, 7.0, None], [1, 1, 3, 5, 7, 7]),
        ([None, None, None], [None, None, None]),
        ([None], [None]),
        ([4.0], [4.0]),
        ([None, None, 2.0], [2, 2, 2]),
        ([2.0, None, None], [2, 2, 2]),
        ([0.0, None, None, None, None, None, None, None, None, None, 20.0], list(range(0, 21, 2))),
    ],
)
def test_interpolation_known_answers(readings, values, want):
    # five hours apart: gaps cross the border between days
    assert filled(readings(rows_of(values))) == pytest.approx(want) if None not in want else filled(
        readings(rows_of(values))
    ) == want


def test_interpolation_is_positional_not_by_time(readings):
    rows = [("a", 0, "2024-01-01 00:00:00", 0.0), ("a", 1, "2024-01-01 00:00:01", None), ("a", 2, "2024-03-01 00:00:00", 10.0)]
    assert filled(readings(rows)) == [0.0, 5.0, 10.0]


def test_interpolation_matches_pandas_on_random_series(readings):
    rng = np.random.default_rng(7)
    rows, want = [], []
    for m in range(6):
        v = pd.Series(rng.normal(size=60)).where(rng.random(60) > [0.1, 0.5, 0.9, 0.3, 0.97, 0.6][m])
        rows += rows_of([None if np.isnan(x) else float(x) for x in v], f"m{m}", dt.timedelta(hours=int(rng.integers(1, 40))))
        want += v.interpolate("linear").bfill().ffill().tolist()
    got = [np.nan if x is None else x for x in filled(readings(rows))]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_interpolation_does_not_depend_on_the_block(readings):
    df = readings(rows_of([None, 1.0, None, None, 7.0, None] * 5))
    day, hour = (c.clean_readings(df, ["active_power_kw"], unit=u) for u in ("day", "hour"))
    assert day.exceptAll(hour).count() == 0 and day.count() == 30


def test_readings_are_shuffled_once_for_both_uses(readings):
    df = c.clean_readings(readings(rows_of([1.0, None, 3.0])), ["active_power_kw"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_dedup_keeps_the_first_in_file_order(readings):
    rows = [("a", 5, str(T0), 5.0), ("a", 2, str(T0), None), ("a", 9, str(T0), 9.0), ("b", 1, str(T0), 1.0)]
    got = c.dedup_first(readings(rows), ["meter_id", "ts"], "seq").orderBy("meter_id").collect()
    assert [(r["meter_id"], r["seq"], r["active_power_kw"]) for r in got] == [("a", 2, None), ("b", 1, 1.0)]


def test_copies_go_before_the_shuffle(readings):
    plan = c.dedup_first(readings(rows_of([1.0])), ["meter_id", "ts"], "seq")._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_quality_report(readings):
    rows = rows_of([1.0, None, 3.0, None]) + [("a", 10, str(T0), 8.0), ("a", 11, None, 2.0)]
    r = c.quality_report(readings(rows), ["active_power_kw"]).collect()[0]
    assert (r["initial_records"], r["invalid_times"], r["duplicates"], r["final_records"]) == (6, 1, 1, 4)
    assert (r["missing_records_filled"], r["missing_pct"]) == (2, 50.0)
    assert (str(r["start_date"]), str(r["end_date"]), r["clean_daily_records"]) == ("2024-01-01", "2024-01-01", 1)


def test_quality_report_by_another_tie(readings):
    raw = readings([("a", 1, "2024-01-01 00:00:00", None), ("a", 2, "2024-01-01 00:00:00", 5.0)])
    filled = lambda df, **kw: c.quality_report(df, ["active_power_kw"], **kw).head()["missing_records_filled"]
    assert filled(raw) == 1
    assert filled(raw.withColumn("version", -raw["seq"]).drop("seq"), tie="version") == 0


def test_spine_fills_empty_days(spark):
    df = spark.sql(
        "SELECT 'a' AS meter_id, day, 2.0D AS power_sum, 1.0D AS power_mean FROM VALUES (date'2024-02-27'), (date'2024-03-01') AS t(day)"
        " UNION ALL SELECT 'b', date'2024-01-01', 3.0D, 3.0D"
    )
    got = day_spine(df, ["power_sum"]).orderBy("meter_id", "day").collect()
    assert [(r["meter_id"], str(r["day"]), r["power_sum"], r["power_mean"]) for r in got] == [
        ("a", "2024-02-27", 2.0, 1.0), ("a", "2024-02-28", 0.0, None), ("a", "2024-02-29", 0.0, None),
        ("a", "2024-03-01", 2.0, 1.0), ("b", "2024-01-01", 3.0, 3.0),
    ]


def test_rollup_of_one_reading_has_no_deviation(spark):
    df = spark.sql(
        "SELECT 'a' AS meter_id, timestamp'2024-01-01 10:00:00' AS ts, 6.0D AS active_power_kw, 0.1D AS reactive_power_kw,"
        " 230.0D AS voltage, 1.0D AS intensity, 10.0D AS sub1_wh, 20.0D AS sub2_wh, 30.0D AS sub3_wh"
    )
    r = resample_daily(df).collect()[0]
    assert r["power_std"] is None and r["kwh"] == pytest.approx(0.1) and r["remainder_wh"] == pytest.approx(40.0)


def test_remainder_is_not_negative(spark):
    df = spark.sql("SELECT 1.0D AS power_sum, 10.0D AS sub1_wh, 20.0D AS sub2_wh, 30.0D AS sub3_wh")
    assert add_energy(df).collect()[0]["remainder_wh"] == 0.0


@pytest.mark.parametrize("date, time, ok", [("1/1/2007", "00:01:00", True), ("31/02/2007", "00:01:00", False), ("x", "y", False), ("16/12/2006", "17:24:00", True)])
def test_minute_times(spark, date, time, ok):
    df = spark.createDataFrame([(date, time)], "Date STRING, Time STRING").select(c.parse_minute_ts().alias("t"))
    assert (df.collect()[0]["t"] is not None) == ok


def test_numbers_from_dirty_text(spark):
    df = spark.createDataFrame([("1.5",), ("?",), ("",), ("abc",), (None,)], "v STRING")
    assert [r["v"] for r in c.numeric_columns(df, ["v"]).collect()] == [1.5, None, None, None, None]
