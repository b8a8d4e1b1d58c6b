"""Report tables over daily series, readings and profiles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import day_label, day_name, day_type, hour_label, is_weekend, month_name
from ..functions.numeric import clip0, envelope, kwh_to_mwh, pct_change
from ..schema import DAY, KWH, METER, TS
from .features import add_trailing_mean
from .series import last_rows

HOT_ABOVE = 30.0
MILD_UP_TO = 26.0

# Load zone -> hours of the day.
LOAD_ZONES = {
    "valley": [1, 2, 3, 4],
    "mid_day": [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17],
    "evening_peak": [18, 19, 20, 21],
    "late_night": [22, 23, 0],
}


def _first_day_at_max(y: str, time: str) -> Column:
    return F.min_by(F.col(time), F.struct((-F.col(y)).alias("y"), F.col(time).alias("t")))


def _first_day_at_min(y: str, time: str) -> Column:
    return F.min_by(F.col(time), F.struct(F.col(y).alias("y"), F.col(time).alias("t")))


# ---------------------------------------------------------------- hour of day


def hourly_profile(
    raw: DataFrame, key=[METER], time: str = TS, hour: Column | None = None, places: tuple[int, int] = (3, 2)
) -> DataFrame:
    """24 rows per meter: power statistics and sub-meter means by hour of day.

    Readings without power are left out, nothing is interpolated. Hours without
    readings stay, with nulls. Only the columns named here are read.
    """
    p = F.col("active_power_kw")
    power, sub = places
    stats = {
        "mean_power_kw": F.round(F.avg(p), power),
        "std_power_kw": F.round(F.stddev_samp(p), power),
        "max_power_kw": F.round(F.max(p), power),
        "min_power_kw": F.round(F.min(p), power),
        "sub1_kitchen_wh": F.round(F.avg("sub1_wh"), sub),
        "sub2_laundry_wh": F.round(F.avg("sub2_wh"), sub),
        "sub3_climate_wh": F.round(F.avg("sub3_wh"), sub),
    }
    by_hour = (
        raw.where(p.isNotNull())
        .groupBy(*key, (hour if hour is not None else F.hour(time)).alias("hour"))
        .agg(*[c.alias(n) for n, c in stats.items()])
    )
    # at most 24 rows per meter meet here
    packed = by_hour.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*stats).alias("s")))).alias("m")
    )
    rows = packed.select(*key, "m", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    s = F.col("m")[F.col("hour")]
    return rows.select(*key, "hour", hour_label("hour").alias("hour_label"), *[s[n].alias(n) for n in stats])


def peak_hours(profile: DataFrame, key=[METER]) -> DataFrame:
    """Hours of highest and lowest mean power; the earlier hour wins a tie."""
    known = profile.where(F.col("mean_power_kw").isNotNull())
    m = F.col("mean_power_kw")
    out = known.groupBy(*key).agg(
        F.min_by("hour", F.struct((-m).alias("m"), F.col("hour").alias("h"))).alias("peak_hour"),
        F.max(m).alias("peak_hour_power_kw"),
        F.min_by("hour", F.struct(m.alias("m"), F.col("hour").alias("h"))).alias("min_hour"),
        F.min(m).alias("min_hour_power_kw"),
    )
    return out.withColumns(
        {"peak_hour_label": hour_label("peak_hour"), "min_hour_label": hour_label("min_hour")}
    )


def profile_envelope(profile: DataFrame) -> DataFrame:
    lower, upper = envelope("mean_power_kw", "std_power_kw")
    return profile.withColumns({"lower_kw": lower, "upper_kw": upper})


def zone_of(hour: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(h), F.lit(z)) for z, hs in LOAD_ZONES.items() for h in hs))
    return names[hour]


def load_zones(profile: DataFrame, key=[METER]) -> DataFrame:
    """Mean and highest hourly mean power of each load zone."""
    return (
        profile.withColumn("zone", zone_of(F.col("hour")))
        .groupBy(*key, "zone")
        .agg(
            F.avg("mean_power_kw").alias("mean_power_kw"),
            F.max("mean_power_kw").alias("max_power_kw"),
            F.count("mean_power_kw").alias("hours"),
        )
    )


# ------------------------------------------------------------- day groupings


def trend(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """The series with its 7- and 30-day trailing means."""
    return add_trailing_mean(daily.select(*key, time, y), (7, 30), key, time, y)


def dow_stats(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Mean, standard deviation and count by day of week, Monday = 0. A day of
    week with fewer than two rows has no deviation and is left out."""
    out = daily.groupBy(*key, F.weekday(time).alias("day_of_week"), day_name(time).alias("day_name")).agg(
        F.avg(y).alias("mean_kwh"), F.stddev_samp(y).alias("std_kwh"), F.count(y).alias("days")
    )
    return out.dropna(subset=["mean_kwh", "std_kwh"])


def weekend_means(time: str, y: str) -> tuple[Column, Column]:
    w = is_weekend(time)
    return F.avg(F.when(w == 1, F.col(y))), F.avg(F.when(w == 0, F.col(y)))


def weekend_effect(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    we, wd = weekend_means(time, y)
    out = daily.groupBy(*key).agg(we.alias("weekend_mean"), wd.alias("weekday_mean"))
    return out.withColumn("diff_pct", pct_change("weekend_mean", "weekday_mean"))


def find_column(df: DataFrame, *parts: str) -> str | None:
    """First column whose lower-cased name contains one of ``parts``."""
    return next((c for c in df.columns if any(p in c.lower() for p in parts)), None)


def temperature_effect(daily: DataFrame, temperature: str | None = None, key=[METER], y=KWH) -> DataFrame | None:
    """Mean on hot and on mild days; ``None`` when there is no temperature column."""
    t = temperature or find_column(daily, "temp")
    if t is None:
        return None
    out = daily.groupBy(*key).agg(
        F.avg(F.when(is_hot(t), F.col(y))).alias("hot_mean"),
        F.avg(F.when(is_mild(t), F.col(y))).alias("mild_mean"),
    )
    return out.withColumn("diff_pct", pct_change("hot_mean", "mild_mean"))


def ols(df: DataFrame, x: str, y: str = KWH, by: list[str] = []) -> DataFrame:
    """Least-squares line of ``y`` on ``x``, one per group; partial sums only."""
    yc, xc = F.col(y), F.col(x)
    return df.groupBy(*by).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.corr(yc, xc).alias("corr"),
    )


# --------------------------------------------------------------- distribution


def box_stats(daily: DataFrame, by: list[str], y: str = KWH) -> DataFrame:
    """Quartiles and the 1.5 IQR fences of each group.

    Exact percentiles: a group must be bounded by the calendar (days of one
    meter). Pass ``y`` of daily rows, not of raw readings.
    """
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = daily.groupBy(*by).agg(F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), q.alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    return out.select(
        *by,
        "n",
        "min",
        q1.alias("q1"),
        F.col("_q")[1].alias("median"),
        q3.alias("q3"),
        "max",
        (q1 - 1.5 * (q3 - q1)).alias("lower_fence"),
        (q3 + 1.5 * (q3 - q1)).alias("upper_fence"),
    )


def outliers(daily: DataFrame, by: list[str], y: str = KWH) -> DataFrame:
    """Rows outside the fences of their group, in one pass over the group."""
    w = Window.partitionBy(*by)
    d = daily.withColumn("_q", F.percentile(y, F.array(F.lit(0.25), F.lit(0.75))).over(w))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return d.withColumns({"lower_fence": lower, "upper_fence": upper}).drop("_q").where(
        (F.col(y) < F.col("lower_fence")) | (F.col(y) > F.col("upper_fence"))
    )


def monthly_box(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    d = daily.withColumns({"month": F.month(time), "month_name": month_name(time)})
    return box_stats(d, [*key, "month", "month_name"], y)


def day_type_box(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return box_stats(daily.withColumn("day_type", day_type(time)), [*key, "day_type"], y)


def outlier_days(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return outliers(daily.withColumn("day_type", day_type(time)), [*key, "day_type"], y)


def occupancy_box(daily: DataFrame, occupancy: str | None = None, key=[METER], y=KWH) -> DataFrame | None:
    """Distribution by number of people; ``None`` when there is no such column."""
    c = occupancy or find_column(daily, "people", "occupan")
    return None if c is None else box_stats(daily, [*key, c], y)


def histogram(daily: DataFrame, bins: int = 40, key=[METER], y=KWH) -> DataFrame:
    """Counts in equal bins between a meter's smallest and largest day, with the
    mean and median. The maximum belongs to the last bin, a constant series to
    the first. Empty bins have no row."""
    w = Window.partitionBy(*key)
    d = daily.where(F.col(y).isNotNull()).select(
        *key,
        F.col(y),
        F.min(y).over(w).alias("lo"),
        F.max(y).over(w).alias("hi"),
        F.avg(y).over(w).alias("mean"),
        F.percentile(y, F.lit(0.5)).over(w).alias("median"),
    )
    bucket = F.least(F.width_bucket(F.col(y), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    width = (F.col("hi") - F.col("lo")) / bins
    out = d.withColumn("bin", F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(bucket))
    return (
        out.groupBy(*key, "bin", "lo", "hi", "mean", "median")
        .agg(F.count(F.lit(1)).alias("days"))
        .select(
            *key,
            "bin",
            (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_start"),
            (F.col("lo") + width * F.col("bin")).alias("bin_end"),
            "days",
            "mean",
            "median",
        )
    )


# ------------------------------------------------------------- single figures


def submeter_share_exprs(y: str = KWH) -> dict[str, Column]:
    total = F.sum(y)

    def share(c: str) -> Column:
        return F.when(total > 0, F.sum(c) / 1000.0 / total * 100.0)

    s1, s2, s3 = share("sub1_wh"), share("sub2_wh"), share("sub3_wh")
    return {
        "kitchen_pct": s1,
        "laundry_pct": s2,
        "climate_pct": s3,
        "other_pct": clip0(100.0 - (s1 + s2 + s3)),
    }


def submeter_shares(daily: DataFrame, key=[METER], y=KWH) -> DataFrame:
    """Share of each sub-meter in the total energy; the rest is not negative."""
    return daily.groupBy(*key).agg(*[c.alias(n) for n, c in submeter_share_exprs(y).items()])


def kpi_exprs(time: str = DAY, y: str = KWH) -> dict[str, Column]:
    return {
        "days": F.count(F.lit(1)),
        "start_date": F.min(time),
        "end_date": F.max(time),
        "mean_kwh": F.avg(y),
        "max_kwh": F.max(y),
        "max_date": _first_day_at_max(y, time),
        "total_mwh": kwh_to_mwh(F.sum(y)),
    }


def kpis(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return daily.groupBy(*key).agg(*[c.alias(n) for n, c in kpi_exprs(time, y).items()])


def recent_mean(daily: DataFrame, n: int = 14, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Mean of the last ``n`` rows of each meter (fewer when the series is short)."""
    return last_rows(daily.select(*key, time, y), key, time, n).groupBy(*key).agg(
        F.avg(y).alias("recent_mean"), F.count(y).alias("rows")
    )


def history_overview(daily: DataFrame, key=[METER], time=DAY, y=KWH) -> DataFrame:
    return daily.groupBy(*key).agg(
        F.min(time).alias("first_day"),
        F.max(time).alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.round(F.count(F.lit(1)) / 365.25, 1).alias("years"),
        F.avg(y).alias("mean_kwh"),
        kwh_to_mwh(F.sum(y)).alias("total_mwh"),
    )


def autocorr(daily: DataFrame, lag: int = 7, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Correlation of the series with itself ``lag`` rows earlier."""
    w = Window.partitionBy(*key).orderBy(time)
    d = daily.select(*key, F.col(y), F.lag(y, lag).over(w).alias("_then")).where(F.col("_then").isNotNull())
    return d.groupBy(*key).agg(F.corr(y, "_then").alias("autocorr"), F.count(F.lit(1)).alias("pairs"))


def top_peak_days(daily: DataFrame, n: int = 10, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """The ``n`` highest days of each meter; the earlier day wins a tie."""
    w = Window.partitionBy(*key).orderBy(F.col(y).desc(), F.col(time))
    return (
        daily.select(*key, time, y)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .withColumn("label", day_label(time))
    )


def tail(daily: DataFrame, n: int, key=[METER], time=DAY) -> DataFrame:
    """Last ``n`` rows per meter."""
    return last_rows(daily, key, time, n)


def is_hot(temperature: str) -> Column:
    return F.col(temperature) > HOT_ABOVE


def is_mild(temperature: str) -> Column:
    return F.col(temperature) <= MILD_UP_TO
