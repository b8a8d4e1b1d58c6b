import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattframe.operators import features as f
from wattframe.operators import split as sp
from wattframe.operators.series import block_of, in_chunks, with_position
from wattframe.schema import FEATURES

RNG = np.random.default_rng(3)
WAVE = [20 + 5 * math.sin(i / 7) + float(RNG.normal()) for i in range(80)]


def test_36_features_in_order_and_30_rows_fewer(series):
    out = f.engineer_features(series({"a": WAVE, "b": WAVE[:40]}))
    assert len(FEATURES) == 36 and out.columns == ["meter_id", "date", "kwh", *FEATURES]
    assert {r["meter_id"]: r["count"] for r in out.groupBy("meter_id").count().collect()} == {"a": 50, "b": 10}
    assert FEATURES[:2] == ["day", "day_of_week"] and FEATURES[-1] == "ratio_lag1_rolling7"


def test_features_match_pandas(series):
    y = pd.Series(WAVE)
    got = f.engineer_features(series({"a": WAVE})).orderBy("date").toPandas()
    want = pd.DataFrame(
        {
            "lag_1": y.shift(1), "lag_30": y.shift(30),
            "rolling_mean_7": y.shift(1).rolling(7).mean(), "rolling_std_14": y.shift(1).rolling(14).std(),
            "rolling_min_30": y.shift(1).rolling(30).min(), "rolling_max_7": y.shift(1).rolling(7).max(),
        }
    )[30:].reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want)
    ratio = y.shift(1) / (y.shift(1).rolling(7).mean() + 1e-5)
    np.testing.assert_allclose(got["ratio_lag1_rolling7"], ratio[30:])


def test_features_know_nothing_of_the_current_row(series):
    changed = WAVE[:-1] + [9999.0]
    a, b = (
        f.engineer_features(series({"a": v})).orderBy(F.col("date").desc()).select(*FEATURES).first() for v in (WAVE, changed)
    )
    assert a == b


def test_one_exchange_one_window(series):
    lags = f.add_rolling(f.add_lags(series({"a": WAVE})))
    w = f.series_window(["meter_id"], "day")
    one = series({"a": WAVE}).select("*", *[c.alias(n) for n, c in {**f.lag_exprs(w), **f.rolling_exprs(w)}.items()])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1
    assert lags.count() == 80


@pytest.mark.parametrize("values, k, want", [([3, 4, 5, 6], 3, [3, 3, 3, 3]), ([3, 4], 7, [None, None]), ([5], 1, [None]), ([5, 6], 1, [5, 5])])
def test_filled_lags(series, values, k, want):
    out = f.add_filled_lags(series({"a": values}), (k,)).orderBy("day").collect()
    assert [r[f"lag_{k}_filled"] for r in out] == want


def test_trailing_mean_allows_short_windows(series):
    out = f.add_trailing_mean(series({"a": [1, 3, 5]}), (2,)).orderBy("day").collect()
    assert [r["trailing_mean_2"] for r in out] == [1.0, 2.0, 4.0]


def _hours(spark, n=2000, meters=3):
    return spark.range(n * meters).selectExpr(
        f"concat('m', id % {meters}) AS meter_id",
        f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, 977.0 * (id div {meters})) AS ts",
        "(id * 7919) % 1009 + 0.5D AS kwh",
    )


def test_position_is_the_row_number(spark):
    from pyspark.sql import Window

    df = with_position(_hours(spark), ["meter_id"], "ts")
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("meter_id").orderBy("ts")))
    assert plain.where("rn <> _pos").count() == 0 and plain.count() == 6000


@pytest.mark.parametrize("chunk_rows", [31, 100, 1000, 5000])
def test_chunks_equal_the_whole_series(spark, chunk_rows):
    df = _hours(spark)

    def look_back(d, key):
        w = f.series_window(key, "ts")
        new = {**f.lag_exprs(w, "kwh", [1, 7, 30]), **f.rolling_exprs(w, "kwh", [7, 30])}
        return d.select("*", *[c.alias(n) for n, c in new.items()])

    whole = look_back(df, ["meter_id"])
    cut = in_chunks(df, ["meter_id"], "ts", 30, look_back, chunk_rows)
    assert cut.columns == whole.columns
    assert cut.exceptAll(whole).count() == 0 and cut.count() == whole.count()


@pytest.mark.parametrize("unit", ["day", "hour", "minute", "second"])
def test_position_does_not_depend_on_the_block(spark, unit):
    a = with_position(_hours(spark), ["meter_id"], "ts", block_of("ts", unit))
    b = with_position(_hours(spark), ["meter_id"], "ts")
    assert a.exceptAll(b).count() == 0


def test_chunks_need_room_for_the_look_back(spark):
    with pytest.raises(ValueError):
        in_chunks(_hours(spark, 10), ["meter_id"], "ts", 30, lambda d, k: d, 30)


def test_chronological_split(series):
    out = sp.split_chrono(series({"a": range(10), "b": range(3), "c": [1]})).orderBy("meter_id", "day").collect()
    assert [r["split"] for r in out] == ["train"] * 8 + ["test"] * 2 + ["train"] * 2 + ["test"] + ["test"]


def test_validation_split_keeps_at_least_one_row(series):
    out = sp.split_validation(series({"a": [1], "b": range(20)})).groupBy("meter_id", "part").count().collect()
    assert {(r["meter_id"], r["part"]): r["count"] for r in out} == {("a", "fit"): 1, ("b", "fit"): 17, ("b", "validate"): 3}


@pytest.mark.parametrize("n, lookback, want", [(1442, 30, 30), (75, 30, 11), (40, 30, 7), (76, 30, 30)])
def test_effective_lookback(spark, n, lookback, want):
    assert spark.range(1).select(sp.effective_lookback(F.lit(n), lookback).alias("l")).first()["l"] == want


def test_sequences(series):
    out = f.make_sequences(series({"a": range(6)}), 3).orderBy("day").collect()
    assert [(list(r["window"]), r["label"]) for r in out] == [([0, 1, 2], 3), ([1, 2, 3], 4), ([2, 3, 4], 5)]
