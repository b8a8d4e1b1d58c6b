"""Calendar expressions over a DATE (or timestamp) column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_weekend(day) -> Column:
    return F.when(F.weekday(_col(day)) >= 5, 1).otherwise(0)


def day_type(day) -> Column:
    return F.when(F.weekday(_col(day)) >= 5, "Weekend (Sat-Sun)").otherwise("Weekday (Mon-Fri)")


def calendar_parts(day) -> dict[str, Column]:
    """Numeric calendar values; Monday is day 0 of the week."""
    d = _col(day)
    return {
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "is_weekend": is_weekend(d),
        "month": F.month(d),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "day_of_year": F.dayofyear(d),
    }


def day_name(day) -> Column:
    return F.date_format(_col(day), "EEEE")


def month_name(day) -> Column:
    return F.date_format(_col(day), "MMM")


def cyclical_parts(day) -> dict[str, Column]:
    """Day of week and month placed on the unit circle."""
    week = F.weekday(_col(day)) * F.lit(2 * math.pi / 7.0)
    year = F.month(_col(day)) * F.lit(2 * math.pi / 12.0)
    return {
        "sin_dow": F.sin(week),
        "cos_dow": F.cos(week),
        "sin_month": F.sin(year),
        "cos_month": F.cos(year),
    }


def day_label(day) -> Column:
    """``2024-01-31 (Wed)``."""
    return F.date_format(_col(day), "yyyy-MM-dd (EEE)")


def hour_label(hour) -> Column:
    return F.format_string("%02d:00", _col(hour))


def future_days(last_day, horizon: int) -> Column:
    """Array of the ``horizon`` days after ``last_day``."""
    d = _col(last_day)
    return F.sequence(F.date_add(d, 1), F.date_add(d, horizon))
