"""Streaming forms of the roll-ups. Times must be TIMESTAMP (watermarks refuse
TIMESTAMP_NTZ); days are those of the session time zone, so keep it at UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import METER, TS


def with_event_time(df: DataFrame, time: str = TS, delay: str = "1 day") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def dedup_stream(readings: DataFrame, keys: list[str] = [METER, TS], time: str = TS, delay: str = "1 day") -> DataFrame:
    """One reading per key; the memory of a key ends with the watermark."""
    return with_event_time(readings, time, delay).dropDuplicatesWithinWatermark(keys)


def keep_first_stream(readings: DataFrame, tie: str, keys: list[str] = [METER, TS], time: str = TS, delay: str = "1 day") -> DataFrame:
    """One reading per key: of the copies that arrive in time, the one with the lowest
    ``tie``, whatever the order they arrive in. ``keys`` must hold the time; a key is
    given out, once, when the watermark has passed it, and its memory ends."""
    rest = [c for c in readings.columns if c not in keys]
    first = F.min_by(F.struct(*rest), tie).alias("_first")
    return with_event_time(readings, time, delay).groupBy(*keys).agg(first).select(*keys, "_first.*")


def daily_stream(
    readings: DataFrame,
    y: str = "active_power_kw",
    time: str = TS,
    delay: str = "1 day",
    readings_per_hour: int = 60,
    key=[METER],
) -> DataFrame:
    """Daily energy per meter. In append mode a day is emitted once, when the
    watermark has passed its end; in update mode with every change."""
    return (
        with_event_time(readings, time, delay)
        .groupBy(F.window(time, "1 day"), *key)
        .agg((F.sum(y) / float(readings_per_hour)).alias("kwh"), F.count(y).alias("readings"))
    )


def as_days(daily: DataFrame, key=[METER]) -> DataFrame:
    return daily.select(*key, F.to_date("window.start").alias("day"), "kwh", "readings")


def sliding_mean_stream(daily: DataFrame, days: int = 7, key=[METER]) -> DataFrame:
    """Mean of the closed days in each ``days``-day window, moving by one day."""
    return (
        daily.groupBy(F.window(F.window_time("window"), f"{days} days", "1 day").alias("span"), *key)
        .agg(F.avg("kwh").alias("mean_kwh"), F.count(F.lit(1)).alias("days"))
        .select(*key, F.to_date("span.start").alias("first_day"), F.to_date("span.end").alias("until"), "mean_kwh", "days")
    )
