"""From clean readings to one row per meter and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import calendar_parts, day_name, month_name
from ..functions.numeric import clip0
from ..schema import DAY, KWH, METER, TS

MEANS_MAX_MIN_STD = ["power_mean", "power_max", "power_min", "power_std"]
SUMS = ["power_sum", "sub1_wh", "sub2_wh", "sub3_wh"]


def resample_daily(
    clean: DataFrame, key: list[str] = [METER], time: str = TS, day: str = DAY, readings_per_hour: int = 60
) -> DataFrame:
    """Daily sums, means and extremes; energy in kWh and the unmetered remainder in Wh.

    Reads the ``day`` column left by ``clean_readings`` when there is one: the
    readings are already partitioned by it, and the roll-up needs no shuffle.
    """
    d = clean if day in clean.columns else clean.withColumn(day, F.to_date(time))
    p = F.col("active_power_kw")
    daily = d.groupBy(*key, day).agg(
        F.sum(p).alias("power_sum"),
        F.avg(p).alias("power_mean"),
        F.max(p).alias("power_max"),
        F.min(p).alias("power_min"),
        F.stddev_samp(p).alias("power_std"),
        F.avg("reactive_power_kw").alias("reactive_power_mean"),
        F.avg("voltage").alias("voltage_mean"),
        F.avg("intensity").alias("intensity_mean"),
        F.sum("sub1_wh").alias("sub1_wh"),
        F.sum("sub2_wh").alias("sub2_wh"),
        F.sum("sub3_wh").alias("sub3_wh"),
    )
    return daily.transform(add_energy, readings_per_hour)


def add_energy(daily: DataFrame, readings_per_hour: int = 60) -> DataFrame:
    kwh = F.col("power_sum") / float(readings_per_hour)
    metered = F.col("sub1_wh") + F.col("sub2_wh") + F.col("sub3_wh")
    return daily.withColumn(KWH, kwh).withColumn("remainder_wh", clip0(F.col(KWH) * 1000.0 - metered))


def day_spine(
    daily: DataFrame, sums: list[str], key: list[str] = [METER], day: str = DAY
) -> DataFrame:
    """Every day between a meter's first and last; sums of an empty day are 0,
    other columns null.

    Each row brings the empty days up to the next row, so the daily table is
    read once and nothing is joined. ``(key, day)`` must be unique.
    """
    following = F.lead(day).over(Window.partitionBy(*key).orderBy(day))
    until = F.coalesce(F.date_sub(following, 1), F.col(day))
    d = daily.withColumn("_own", F.col(day)).withColumn("_until", until)
    d = d.withColumn(day, F.explode(F.sequence("_own", "_until", F.expr("interval 1 day"))))
    real = F.col(day) == F.col("_own")

    def value(c: str):
        if c in (*key, day):
            return F.col(c)
        kept = F.when(real, F.col(c))
        return (F.coalesce(kept, F.lit(0.0)) if c in sums else kept).alias(c)

    return d.select(*[value(c) for c in daily.columns])


def add_calendar(daily: DataFrame, day: str = DAY) -> DataFrame:
    """The ten calendar columns of a daily table.

    The day of the month is called ``day_of_month`` here because ``day`` is the key.
    """
    parts = calendar_parts(day)
    parts["day_of_month"] = parts.pop("day")
    return daily.withColumns({**parts, "day_name": day_name(day), "month_name": month_name(day)})
