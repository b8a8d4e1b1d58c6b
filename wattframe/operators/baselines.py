"""Forecasts that need no training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import future_days
from ..functions.numeric import clip0
from ..schema import DAY, HISTORY_ROWS, KWH, METER
from .series import last_rows


def baseline_persistence(split: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Test rows predicted by the value before them (``split`` has a ``split`` column)."""
    w = Window.partitionBy(*key).orderBy(time)
    return split.withColumn("prediction", F.lag(y, 1).over(w)).where(
        (F.col("split") == "test") & F.col("prediction").isNotNull()
    )


def baseline_ma(split: DataFrame, n: int = 7, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Test rows predicted by the mean of the ``n`` values before them."""
    past = Window.partitionBy(*key).orderBy(time).rowsBetween(-n, -1)
    return split.withColumn("prediction", F.when(F.count(y).over(past) == n, F.avg(y).over(past))).where(
        (F.col("split") == "test") & F.col("prediction").isNotNull()
    )


def history_buffer(daily: DataFrame, n: int = HISTORY_ROWS, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """One row per meter: last day and the last ``n`` values, oldest first.

    The row limit is applied before the shuffle, so at most ``n`` rows per meter
    and task move, and the array never holds more than ``n`` values.
    """
    recent = last_rows(daily.select(*key, time, y), key, time, n)
    return recent.groupBy(*key).agg(
        F.max(time).alias("last_day"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(y).alias("v")))), lambda s: s["v"]
        ).alias("buf"),
    )


def forecast_baseline(
    daily: DataFrame, kind: str = "persistence", horizon: int = 30, n: int = 7, key=[METER], time=DAY, y=KWH
) -> DataFrame:
    """Roll a baseline ``horizon`` days ahead, feeding predictions back.

    ``persistence`` repeats the last value; ``ma`` averages the last ``n`` values,
    predictions included. One projection over one row per meter, no loop.
    """
    buf = history_buffer(daily, max(n, 1), key, time, y)
    if kind == "persistence":
        steps = F.array_repeat(F.element_at("buf", -1), horizon)
    elif kind == "ma":

        def push(acc, _step):
            recent = F.slice(acc, F.greatest(F.size(acc) - n, F.lit(0)) + 1, n)
            mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / F.size(recent)
            return F.concat(acc, F.array(mean))

        rolled = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("buf"), push)
        steps = F.slice(rolled, F.size("buf") + 1, horizon)
    else:
        raise ValueError(f"unknown baseline {kind!r}")
    rows = buf.select(*key, F.posexplode(F.arrays_zip(future_days("last_day", horizon).alias("d"), steps.alias("v"))))
    return rows.select(
        *key,
        F.lit(kind).alias("model"),
        F.lit(horizon).alias("horizon"),
        (F.col("pos") + 1).alias("step"),
        F.col("col.d").alias(time),
        clip0(F.col("col.v")).alias("forecast_kwh"),
    )
