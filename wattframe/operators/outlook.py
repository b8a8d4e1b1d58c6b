"""Tables built on a forecast: ``(meter_id, model, horizon, step, day, forecast_kwh)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import day_label, day_name, is_weekend
from ..functions.numeric import band, pct_change
from ..schema import DAY, KWH, METER

GROUP = [METER, "model", "horizon"]


def finish_forecast(fc: DataFrame, time=DAY, places: int = 2) -> DataFrame:
    """Rounded values with the name and class of the day."""
    return fc.withColumns(
        {
            "forecast_kwh": F.round("forecast_kwh", places),
            "day_name": day_name(time),
            "is_weekend": is_weekend(time),
        }
    )


def summary_exprs(time=DAY) -> dict[str, Column]:
    y, t = F.col("forecast_kwh"), F.col(time)
    top = F.min_by(t, F.struct((-y).alias("y"), t.alias("t")))
    low = F.min_by(t, F.struct(y.alias("y"), t.alias("t")))
    return {
        "horizon_days": F.count(F.lit(1)),
        "expected_avg_kwh": F.round(F.avg(y), 2),
        "total_expected_kwh": F.round(F.sum(y), 2),
        "max_forecast_kwh": F.round(F.max(y), 2),
        "max_forecast_date": day_label(top),
        "min_forecast_kwh": F.round(F.min(y), 2),
        "min_forecast_date": day_label(low),
    }


def forecast_summary(fc: DataFrame, by=GROUP, time=DAY) -> DataFrame:
    """Mean, total, highest and lowest day; the first day wins a tie. Pass the
    rounded forecast."""
    return fc.groupBy(*by).agg(*[c.alias(n) for n, c in summary_exprs(time).items()])


def weekend_effect_exprs(time=DAY) -> dict[str, Column]:
    y, w = F.col("forecast_kwh"), is_weekend(time)
    return {
        "weekend_mean": F.coalesce(F.avg(F.when(w == 1, y)), F.avg(y)),
        "weekday_mean": F.coalesce(F.avg(F.when(w == 0, y)), F.avg(y)),
    }


def forecast_weekend_effect(fc: DataFrame, by=GROUP, time=DAY) -> DataFrame:
    """Weekend and weekday means; a class without days takes the overall mean."""
    return fc.groupBy(*by).agg(*[c.alias(n) for n, c in weekend_effect_exprs(time).items()])


def trend_slope(fc: DataFrame, by=GROUP) -> DataFrame:
    """Slope of the forecast over its steps."""
    return fc.groupBy(*by).agg(F.regr_slope(F.col("forecast_kwh"), F.col("step") - 1).alias("slope"))


def forecast_band(fc: DataFrame, pct: float = 0.12) -> DataFrame:
    lower, upper = band("forecast_kwh", pct)
    return fc.withColumns({"lower_kwh": lower, "upper_kwh": upper})


def high_demand_days(fc: DataFrame, daily: DataFrame, factor: float = 1.25, key=[METER], y=KWH) -> DataFrame:
    """Forecast days above ``factor`` times the historical mean."""
    means = daily.groupBy(*key).agg(F.avg(y).alias("historical_mean"))
    return fc.join(means, key).where(F.col("forecast_kwh") > F.col("historical_mean") * factor)


def forecast_delta(fc: DataFrame, daily: DataFrame, key=[METER], y=KWH) -> DataFrame:
    """Forecast mean against the historical mean, in percent."""
    ahead = fc.groupBy(*key, "model", "horizon").agg(F.avg("forecast_kwh").alias("forecast_mean"))
    past = daily.groupBy(*key).agg(F.avg(y).alias("historical_mean"))
    return ahead.join(past, key).withColumn("delta_pct", pct_change("forecast_mean", "historical_mean"))


def history_and_forecast(daily: DataFrame, fc: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """One continuous series, each row marked ``history`` or ``forecast``."""
    past = daily.select(*key, time, F.col(y).alias("kwh"), F.lit("history").alias("kind"))
    ahead = fc.select(*key, time, F.col("forecast_kwh").alias("kwh"), F.lit("forecast").alias("kind"))
    return past.unionByName(ahead)


def bridge(daily: DataFrame, fc: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Last actual and first forecast point of each meter."""
    last = daily.groupBy(*key).agg(F.max(time).alias("last_day"), F.max_by(y, time).alias("last_kwh"))
    first = fc.groupBy(*key, "model").agg(
        F.min(time).alias("first_day"), F.min_by("forecast_kwh", time).alias("first_forecast_kwh")
    )
    return last.join(first, key)


def forecast_distance(a: DataFrame, b: DataFrame, key=[METER], time=DAY) -> DataFrame:
    """Sum of absolute differences of two forecasts, day by day."""
    left = a.select(*key, time, F.col("forecast_kwh").alias("_a"))
    right = b.select(*key, time, F.col("forecast_kwh").alias("_b"))
    return left.join(right, [*key, time]).groupBy(*key).agg(
        F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("distance_kwh"), F.count(F.lit(1)).alias("days")
    )


def fallback_summary(daily: DataFrame, horizon: int = 30, key=[METER], y=KWH) -> DataFrame:
    """Summary from history alone, for meters no model can forecast; no dates."""
    return daily.groupBy(*key).agg(
        F.lit("history").alias("kind"),
        F.lit(horizon).alias("horizon_days"),
        F.round(F.avg(y), 2).alias("expected_avg_kwh"),
        F.round(F.avg(y) * horizon, 2).alias("total_expected_kwh"),
        F.round(F.max(y), 2).alias("max_forecast_kwh"),
        F.round(F.min(y), 2).alias("min_forecast_kwh"),
        F.lit(None).cast("string").alias("max_forecast_date"),
        F.lit(None).cast("string").alias("min_forecast_date"),
    )


def scaled(daily: DataFrame, factors: list[float], key=[METER], y=KWH) -> DataFrame:
    """The series once per load factor; ``scenario`` tells them apart."""
    factor = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    d = daily.withColumn("scenario", factor)
    return d.withColumn(y, F.col(y) * F.col("scenario"))


def with_fallback(fc: DataFrame, daily: DataFrame, horizon: int, key=[METER], y=KWH) -> DataFrame:
    """One summary per meter: of its forecast, or of its history where there is no forecast.

    ``kind`` is ``model`` or ``history``. A meter is routed by the forecast it lacks, so
    none is left out and none comes twice; pass the forecast of one model and horizon.
    """
    forecast = forecast_summary(fc, by=[*key, "model"]).withColumn("kind", F.lit("model"))
    without = daily.join(fc.select(*key).distinct(), key, "left_anti")
    return forecast.unionByName(fallback_summary(without, horizon, key, y), allowMissingColumns=True)
