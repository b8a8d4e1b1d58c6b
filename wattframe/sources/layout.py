"""Which layout a table has, and how to bring it to one row per meter and day."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.cleaning import (
    clean_readings, dedup_first, drop_invalid_time, interpolate_linear, parse_daily_ts, parse_minute_ts,
    quality_report,
)
from ..operators.rollup import add_calendar, day_spine, resample_daily
from ..operators.features import add_filled_lags, add_trailing_mean
from ..schema import DAY, KWH, METER, MINUTE_COLUMNS, READING_COLUMNS, SEQ, TARGET_CANDIDATES, TS


def detect_layout(columns: list[str]) -> str:
    """``minute`` when both the power and the time column exist, else ``daily``."""
    return "minute" if "Global_active_power" in columns and "Time" in columns else "daily"


def date_column(columns: list[str]) -> str:
    """First column with ``date`` in its name, else the first."""
    return next((c for c in columns if "date" in c.lower()), columns[0])


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.lower())).strip("_")


def first_numeric_column(df: DataFrame, skip: tuple[str, ...] = ()) -> str | None:
    """First column of a numeric type, or of text that converts without loss.

    For text this is one aggregate over the table that returns a single row.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if text:
        ok = df.agg(
            *[
                ((F.count(F.col(f"`{c}`")) > 0) & (F.count(F.col(f"`{c}`")) == F.count(F.col(f"`{c}`").try_cast("double")))).alias(f"c{i}")
                for i, c in enumerate(text)
            ]
        ).head()
        numeric += [c for i, c in enumerate(text) if ok[f"c{i}"]]
    return next((c for c in df.columns if c in numeric), None)


def resolve_target(df: DataFrame, candidates: list[str] = TARGET_CANDIDATES, skip: tuple[str, ...] = (SEQ, METER)) -> str:
    """First known target name, else the first numeric column, else the second column."""
    named = next((c for c in candidates if c in df.columns), None)
    return named or first_numeric_column(df, skip) or df.columns[1]


def with_place(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A table that brings no place of its own gets that of its ``order`` columns, rows
    that share them that of their content, however the table is partitioned.
    Without ``order`` the place is the order in which the table is read."""
    if SEQ in raw.columns:
        return raw
    if not order:
        return raw.withColumn(SEQ, F.monotonically_increasing_id())
    own = [F.col(f"`{c}`") for c in raw.columns]
    place = [F.col(f"`{c}`").alias(f"order_{i}") for i, c in enumerate(order)]
    return raw.withColumn(SEQ, F.struct(*place, F.xxhash64(*own).alias("content")))


def minute_readings(raw: DataFrame, meter: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Raw minute rows to typed readings ``(meter_id, ts, seq, 7 values)``."""
    raw = with_place(raw, order)
    who = F.col(meter).cast("string") if meter else F.lit("main")
    return raw.select(
        who.alias(METER),
        parse_minute_ts().alias(TS),
        F.col(SEQ),
        *[F.col(src).try_cast("double").alias(dst) for src, dst in MINUTE_COLUMNS.items()],
    )


def daily_rows(
    raw: DataFrame, meter: str | None = None, fmt: str = "yyyy-MM-dd", target: str | None = None, order: list[str] | None = None
) -> DataFrame:
    """Raw daily rows to ``(meter_id, ts, seq, kwh, src_*)``."""
    raw = with_place(raw, order)
    target = target or resolve_target(raw)
    src = [c for c in raw.columns if c not in (SEQ, meter)]
    who = F.col(meter).cast("string") if meter else F.lit("main")
    own = raw.select(
        who.alias(METER),
        parse_daily_ts(date_column(src), fmt).alias(TS),
        F.col(SEQ),
        F.col(f"`{target}`").try_cast("double").alias(KWH),
        F.struct(*[F.col(f"`{c}`") for c in src]).alias("_src"),
    )
    named = {}
    for c in src:
        n = "src_" + snake(c)
        while n in named:
            n += "_2"
        named[n] = c
    return own.select(METER, TS, SEQ, KWH, *[F.col("_src")[c].alias(n) for n, c in named.items()])


def prepare_daily(
    raw: DataFrame,
    layout: str | None = None,
    meter: str | None = None,
    fmt: str = "yyyy-MM-dd",
    spine: bool | None = None,
    readings_per_hour: int = 60,
    target: str | None = None,
    order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Any raw table to ``(daily, report)``.

    The daily table has the energy, calendar and first lag columns; the report
    has one row per meter. ``spine`` fills missing days; by default that happens
    for minute data only, and a daily table keeps its rows as they are. ``target``
    names the energy column of a daily table; else it is looked for. ``order`` names
    the columns that say which of several copies in a plain table is the first.
    """
    layout = layout or detect_layout(raw.columns)
    if layout == "minute":
        readings = minute_readings(raw, meter, order)
        report = quality_report(readings, READING_COLUMNS, layout=layout)
        daily = resample_daily(clean_readings(readings), readings_per_hour=readings_per_hour)
        sums = ["power_sum", "sub1_wh", "sub2_wh", "sub3_wh", KWH, "remainder_wh"]
    else:
        rows = daily_rows(raw, meter, fmt, target, order)
        report = quality_report(rows, [KWH], layout=layout)
        once = dedup_first(drop_invalid_time(rows), [METER, TS], SEQ)
        month = F.trunc(TS, "month")
        daily = interpolate_linear(once, [KWH], block=month).withColumn(DAY, F.to_date(TS)).where(F.col(KWH).isNotNull())
        sums = [KWH]
    time = TS if layout == "daily" else DAY
    if spine if spine is not None else layout == "minute":
        if layout == "daily":
            daily = daily.groupBy(METER, DAY).agg(F.sum(KWH).alias(KWH))
            time = DAY
        daily = day_spine(daily, sums)
    daily = add_calendar(daily)
    daily = add_trailing_mean(add_filled_lags(daily, (1, 7), time=time), (7,), time=time)
    return daily, report
