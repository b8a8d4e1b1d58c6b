"""Cleaning of readings: times, duplicates, numbers, gaps, quality report."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..schema import METER, READING_COLUMNS, TS
from .series import BLOCK, block_of


def parse_minute_ts(date_col: str = "Date", time_col: str = "Time") -> Column:
    """``1/1/2007`` + ``00:01:00`` to a timestamp; impossible dates give null."""
    text = F.concat_ws(" ", F.col(f"`{date_col}`"), F.col(f"`{time_col}`"))
    return F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm:ss"))


def parse_daily_ts(date_col: str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(F.col(f"`{date_col}`"), F.lit(fmt))


def drop_invalid_time(df: DataFrame, time: str = TS) -> DataFrame:
    return df.where(F.col(time).isNotNull())


def numeric_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Convert text columns to double; text that is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def dedup_first(df: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One row per ``keys``: the one with the lowest ``tie`` (file order).

    Spark keeps the first row per task before the shuffle already
    (``WindowGroupLimit``), so a reading repeated a billion times moves one row
    per task.
    """
    w = Window.partitionBy(*keys).orderBy(tie)
    return df.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") == 1).drop("_copy")


def any_missing(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def interpolate_linear(
    df: DataFrame,
    cols: list[str],
    key: list[str] = [METER],
    time: str = TS,
    block: Column | None = None,
    keep_block: str | None = None,
) -> DataFrame:
    """Fill null cells on the line between the known neighbours.

    Rows count as equally spaced, whatever the time between them. Cells after
    the last known one take its value, cells before the first take that; a
    column without any value stays null. Times must be unique per key.

    The work is per ``(key, block)`` - a day by default, at most 86,400 rows at
    second resolution - so a huge meter spreads over as many tasks as it has
    days. What crosses a block border (rows so far, last known value before,
    first known value after) is computed on one summary row per block and joined
    back on the same keys, which needs no further shuffle of the readings.
    """
    names = df.columns
    # The filter is the one the join below would add on one side only: with it the
    # two uses of the shuffled readings are equal and Spark runs that shuffle once.
    d = df.withColumn(BLOCK, block if block is not None else F.to_date(time))
    d = d.where(F.col(BLOCK).isNotNull())
    for k in key:
        d = d.where(F.col(k).isNotNull())

    group = ", ".join(f"`{k}`" for k in key)
    inside = f"PARTITION BY {group}, {BLOCK} ORDER BY `{time}`"
    across = f"PARTITION BY {group} ORDER BY {BLOCK}"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def each(*templates: str) -> list[str]:
        return [t.format(c=c) for c in cols for t in templates]

    d = d.selectExpr("*", f"row_number() OVER ({inside}) AS _i")
    d = d.selectExpr("*", *each("IF(`{c}` IS NULL, NULL, _i) AS `_i_{c}`"))
    # one row per block: its size, its first and its last known cell of each column
    summary = d.groupBy(*key, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.expr(e)
            for e in each(
                "min(`_i_{c}`) AS `_fi_{c}`",
                "min_by(`{c}`, `_i_{c}`) AS `_fv_{c}`",
                "max(`_i_{c}`) AS `_li_{c}`",
                "max_by(`{c}`, `_i_{c}`) AS `_lv_{c}`",
            )
        ],
    )
    carry = summary.selectExpr("*", f"coalesce(sum(_n) OVER ({across} {earlier}), 0) AS _off").selectExpr(
        *[f"`{k}`" for k in key],
        BLOCK,
        "_off",
        *each(
            f"last(`_li_{{c}}` + _off, true) OVER ({across} {earlier}) AS `_bi_{{c}}`",
            f"last(`_lv_{{c}}`, true) OVER ({across} {earlier}) AS `_bv_{{c}}`",
            f"last(`_fi_{{c}}` + _off, true) OVER ({across} DESC {earlier}) AS `_ai_{{c}}`",
            f"last(`_fv_{{c}}`, true) OVER ({across} DESC {earlier}) AS `_av_{{c}}`",
        ),
    )
    # the neighbours inside the block, then those the other blocks bring
    local = d.selectExpr(
        "*",
        *each(
            f"last(`_i_{{c}}`, true) OVER ({inside} {so_far}) AS `_pi_{{c}}`",
            f"last(`{{c}}`, true) OVER ({inside} {so_far}) AS `_pv_{{c}}`",
        ),
    ).selectExpr(
        "*",
        *each(
            f"last(`_i_{{c}}`, true) OVER ({inside} DESC {so_far}) AS `_qi_{{c}}`",
            f"last(`{{c}}`, true) OVER ({inside} DESC {so_far}) AS `_qv_{{c}}`",
        ),
    )
    sides = local.join(carry, [*key, BLOCK]).selectExpr(
        *[f"`{c}`" for c in names],
        BLOCK,
        "_i + _off AS _pos",
        *each(
            "coalesce(`_pi_{c}` + _off, `_bi_{c}`) AS `_pi_{c}`",
            "coalesce(`_pv_{c}`, `_bv_{c}`) AS `_pv_{c}`",
            "coalesce(`_qi_{c}` + _off, `_ai_{c}`) AS `_qi_{c}`",
            "coalesce(`_qv_{c}`, `_av_{c}`) AS `_qv_{c}`",
        ),
    )
    on_line = "`_pv_{c}` + (`_qv_{c}` - `_pv_{c}`) * (_pos - `_pi_{c}`) / (`_qi_{c}` - `_pi_{c}`)"
    # without a neighbour on one side the line is null and the other side counts
    filled = f"CASE WHEN `{{c}}` IS NOT NULL THEN `{{c}}` ELSE coalesce({on_line}, `_pv_{{c}}`, `_qv_{{c}}`) END AS `{{c}}`"
    out = [filled.format(c=c) if c in cols else f"`{c}`" for c in names]
    if keep_block:
        out.append(f"{BLOCK} AS `{keep_block}`")
    return sides.selectExpr(*out)


def clean_readings(
    raw: DataFrame,
    cols: list[str] = READING_COLUMNS,
    key: list[str] = [METER],
    time: str = TS,
    tie: str = "seq",
    unit: str = "day",
) -> DataFrame:
    """Valid times only, one row per time, gaps filled: key, time, ``cols``, ``day``.

    The tie column ends with the removal of copies. Carrying it (or any column
    that is not filled) would make the two uses of the shuffle differ.

    A day holds at most 86,400 readings at the second resolution of the minute
    layout. For finer times pass a narrower ``unit``.
    """
    once = dedup_first(drop_invalid_time(raw, time).select(*key, time, tie, *cols), [*key, time], tie)
    if unit == "day":
        return interpolate_linear(once.drop(tie), cols, key, time, keep_block="day")
    filled = interpolate_linear(once.drop(tie), cols, key, time, block_of(time, unit))
    return filled.withColumn("day", F.to_date(time))


class Totals(NamedTuple):
    """What a cleaning pass counts on its way: all rows, and the rows that are left."""

    rows: Observation
    left: Observation


def clean_observed(
    raw: DataFrame, cols: list[str] = READING_COLUMNS, key: list[str] = [METER], time: str = TS, tie: str = "seq"
) -> tuple[DataFrame, Totals]:
    """``clean_readings`` and, from the same pass, the totals of what was dropped and filled.

    The totals are there once the clean readings have been written or counted, for
    ``totals_report``. Counting adds no scan and no shuffle.
    """
    totals = Totals(Observation(), Observation())
    rows = raw.select(*key, time, tie, *cols)
    rows = rows.observe(totals.rows, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(time).isNull()).alias("invalid"))
    once = dedup_first(drop_invalid_time(rows, time), [*key, time], tie).drop(tie)
    day = F.to_date(time)
    once = once.observe(
        totals.left,
        F.count(F.lit(1)).alias("times"),
        F.count_if(any_missing(cols)).alias("missing"),
        F.min(day).alias("first"),
        F.max(day).alias("last"),
    )
    return interpolate_linear(once, cols, key, time, keep_block="day"), totals


def totals_report(spark: SparkSession, totals: Totals, layout: str = "minute", target: str = "kwh") -> DataFrame:
    """One row over all meters, with the figures of ``quality_report``. Waits for the cleaning pass."""
    a, b = totals.rows.get, totals.left.get
    share = b["missing"] * 100.0 / b["times"] if b["times"] else None
    row = (layout, a["rows"], a["invalid"], a["rows"] - a["invalid"] - b["times"], b["times"], b["missing"], share, b["first"], b["last"], target)
    names = "dataset_type STRING, initial_records BIGINT, invalid_times BIGINT, duplicates BIGINT, final_records BIGINT, missing_records_filled BIGINT"
    return spark.createDataFrame([row], f"{names}, missing_pct DOUBLE, start_date DATE, end_date DATE, target_column STRING")


def quality_report(
    raw: DataFrame,
    cols: list[str] = READING_COLUMNS,
    key: list[str] = [METER],
    time: str = TS,
    layout: str = "minute",
    target: str = "kwh",
    tie: str = "seq",
) -> DataFrame:
    """One row per meter: what came in, what was dropped, what had to be filled.

    Of several copies the one with the lowest ``tie`` counts, as in ``clean_readings``.
    Copies collapse to ``(key, time)`` and then to ``(key, day)`` before the
    final aggregate, so no step holds a meter's readings in one task.
    """
    per_time = raw.groupBy(*key, time).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by(any_missing(cols), F.col(tie)).alias("_missing"),
    )
    per_day = per_time.groupBy(*key, F.to_date(time).alias("_day")).agg(
        F.sum("_rows").alias("_rows"),
        F.sum(F.when(F.col(time).isNull(), F.col("_rows")).otherwise(0)).alias("_invalid"),
        F.sum(F.when(F.col(time).isNotNull(), 1).otherwise(0)).alias("_times"),
        F.sum(F.when(F.col(time).isNotNull() & F.col("_missing"), 1).otherwise(0)).alias("_missing"),
    )
    rows, bad, times, miss = (F.sum(c) for c in ("_rows", "_invalid", "_times", "_missing"))
    return per_day.groupBy(*key).agg(
        F.lit(layout).alias("dataset_type"),
        rows.alias("initial_records"),
        bad.alias("invalid_times"),
        (rows - bad - times).alias("duplicates"),
        times.alias("final_records"),
        miss.alias("missing_records_filled"),
        F.when(times > 0, miss * 100.0 / times).alias("missing_pct"),
        F.count("_day").alias("days_with_readings"),
        (F.date_diff(F.max("_day"), F.min("_day")) + 1).alias("clean_daily_records"),
        F.min("_day").alias("start_date"),
        F.max("_day").alias("end_date"),
        F.lit(target).alias("target_column"),
    )
