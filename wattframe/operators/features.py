"""Window features of a daily series.

Functions take ``key`` so that the same code runs per meter (a daily series is
bounded by the calendar) or per chunk of a long series (``series.in_chunks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import calendar_parts, cyclical_parts
from ..schema import DAY, EPS_RATIO, FEATURES, KWH, LAGS, METER, ROLLING_WINDOWS


def series_window(key: list[str], time: str):
    return Window.partitionBy(*key).orderBy(time)


def lag_exprs(w, y: str = KWH, lags: list[int] = LAGS) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(y, k).over(w) for k in lags}


def rolling_exprs(w, y: str = KWH, windows: list[int] = ROLLING_WINDOWS) -> dict[str, Column]:
    """Statistics of the ``n`` rows before the current one; null for a short window."""
    out = {}
    for n in windows:
        past = w.rowsBetween(-n, -1)
        full = F.count(y).over(past) == n
        out[f"rolling_mean_{n}"] = F.when(full, F.avg(y).over(past))
        out[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(y).over(past))
        out[f"rolling_min_{n}"] = F.when(full, F.min(y).over(past))
        out[f"rolling_max_{n}"] = F.when(full, F.max(y).over(past))
    return out


def momentum_exprs() -> dict[str, Column]:
    return {
        "diff_lag1_lag2": F.col("lag_1") - F.col("lag_2"),
        "diff_lag1_lag7": F.col("lag_1") - F.col("lag_7"),
        "ratio_lag1_rolling7": F.col("lag_1") / (F.col("rolling_mean_7") + EPS_RATIO),
    }


def _keep(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in new.items()])


def add_lags(df: DataFrame, lags: list[int] = LAGS, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return _keep(df, lag_exprs(series_window(key, time), y, lags))


def add_filled_lags(df: DataFrame, lags=(1, 7), key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Lags whose leading nulls take the first value of the series; a series of
    ``k`` rows or fewer keeps the null. ``y`` must not be null."""
    w = series_window(key, time)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    enough = F.count(F.lit(1)).over(whole)
    first = F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _keep(
        df,
        {f"lag_{k}_filled": F.coalesce(F.lag(y, k).over(w), F.when(enough > k, first)) for k in lags},
    )


def add_trailing_mean(df: DataFrame, windows=(7, 30), key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Mean of up to ``n`` rows ending with the current one."""
    w = series_window(key, time)
    return _keep(df, {f"trailing_mean_{n}": F.avg(y).over(w.rowsBetween(-(n - 1), 0)) for n in windows})


def add_rolling(df: DataFrame, windows=ROLLING_WINDOWS, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return _keep(df, rolling_exprs(series_window(key, time), y, windows))


def add_momentum(df: DataFrame) -> DataFrame:
    return _keep(df, momentum_exprs())


def submeter_trend(daily: DataFrame, n: int = 14, key=[METER], time=DAY) -> DataFrame:
    """Smoothed kWh of the three sub-meters and the remainder (0 where absent)."""
    w = series_window(key, time).rowsBetween(-(n - 1), 0)
    parts = {"kitchen": "sub1_wh", "laundry": "sub2_wh", "climate": "sub3_wh", "remainder": "remainder_wh"}
    return daily.select(
        *key,
        time,
        *[
            (F.avg(c).over(w) / 1000.0 if c in daily.columns else F.lit(0.0)).alias(f"{name}_kwh")
            for name, c in parts.items()
        ],
    )


def engineer_features(
    daily: DataFrame, key=[METER], time: str = DAY, y: str = KWH, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The 36-column feature matrix: key, time, target, features in fixed order.

    All window expressions share one ordering, so the plan has one exchange, one
    sort and one window. The first 30 rows of each series drop out. The calendar
    ``day`` feature is the day of the month, so the key column is returned as
    ``date``. ``keep`` names helper columns to carry through.
    """
    base = daily.select(*key, F.col(time).alias("date"), F.col(y), *keep)
    w = series_window(key, "date")
    lagged = _keep(base, {**lag_exprs(w, y), **rolling_exprs(w, y)})
    full = lagged.withColumns(
        {**calendar_parts("date"), **cyclical_parts("date"), **momentum_exprs()}
    )
    return full.dropna(subset=[*FEATURES, y]).select(*key, "date", y, *keep, *FEATURES)


def make_sequences(df: DataFrame, lookback: int, key=[METER], time=DAY, y=KWH, extra=()) -> DataFrame:
    """``lookback`` values (oldest first) and the value that follows them."""
    past = series_window(key, time).rowsBetween(-lookback, -1)
    seq = df.select(*key, time, *extra, F.col(y).alias("label"), F.collect_list(y).over(past).alias("window"))
    return seq.where(F.size("window") == lookback)
