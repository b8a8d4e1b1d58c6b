"""Reading, cleaning and roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, rollup
from ..sources.layout import minute_readings, prepare_daily
from ..sources.readers import parse_lines, read_telemetry
from ..schema import MINUTE_COLUMNS
from ..session import scratch_path
from . import standins as s
from .base import query

_RAW = ["Date", "Time", *MINUTE_COLUMNS]
_READING_SPEC = (
    "meter_id, ts:t, active_power_kw:6, reactive_power_kw:6, voltage:6, intensity:6, sub1_wh:6, sub2_wh:6, sub3_wh:6"
)


def _raw_cells(spark, sf_dir):
    """Readings as the raw text cells of a minute file."""
    r = s.readings(spark, sf_dir)
    cells = [F.date_format("ts", "d/M/yyyy").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time")]
    for raw, ours in MINUTE_COLUMNS.items():
        cells.append(F.coalesce(F.col(ours).cast("string"), F.lit("?")).alias(raw))
    return r.select("meter_id", "seq", *cells)


@query(f"{_READING_SPEC}, seq:i", f"WITH {s.SQL_READINGS} SELECT * FROM readings")
def parse_minute_lines(spark, sf_dir):
    raw = _raw_cells(spark, sf_dir)
    lines = raw.select("meter_id", "seq", F.concat_ws(";", *_RAW).alias("line"))
    return minute_readings(parse_lines(lines, _RAW), "meter_id")


@query(_READING_SPEC, f"WITH {s.SQL_READINGS} SELECT * FROM readings")
def read_delimited(spark, sf_dir):
    path = scratch_path(spark, "minute-csv")
    _raw_cells(spark, sf_dir).select("meter_id", *_RAW).write.option("header", True).option("sep", ";").csv(path)
    return minute_readings(read_telemetry(spark, path), "meter_id")


@query(
    "meter_id, ts:t, seq:i, active_power_kw:6",
    f"""WITH {s.SQL_READINGS}
SELECT meter_id, date_trunc('hour', ts) AS ts, seq, active_power_kw FROM readings
QUALIFY row_number() OVER (PARTITION BY meter_id, date_trunc('hour', ts) ORDER BY seq) = 1""",
)
def clean_dedup_first(spark, sf_dir):
    hourly = s.readings(spark, sf_dir).select(
        "meter_id", F.date_trunc("hour", "ts").alias("ts"), "seq", "active_power_kw"
    )
    return cleaning.dedup_first(hourly, ["meter_id", "ts"], "seq")


@query(
    "meter_id, ts:t, active_power_kw:6, voltage:6",
    f"WITH {s.sql_interpolated(['active_power_kw', 'voltage'])} SELECT * FROM clean",
)
def interpolate_readings(spark, sf_dir):
    r = s.readings(spark, sf_dir).select("meter_id", "ts", "seq", "active_power_kw", "voltage")
    return cleaning.clean_readings(r, ["active_power_kw", "voltage"])


@query(
    "meter_id, dataset_type, initial_records:i, invalid_times:i, duplicates:i, final_records:i, "
    "missing_records_filled:i, missing_pct:6, days_with_readings:i, clean_daily_records:i, start_date:d, end_date:d, target_column",
    f"""WITH {s.SQL_READINGS},
h AS (SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM readings),
first AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY seq) = 1),
counts AS (SELECT meter_id, count(*) AS n FROM h GROUP BY 1)
SELECT f.meter_id, 'minute' AS dataset_type, min(n) AS initial_records, 0 AS invalid_times,
       min(n) - count(*) AS duplicates, count(*) AS final_records,
       sum(CASE WHEN {' OR '.join(c + ' IS NULL' for c in s.READING_COLUMNS)} THEN 1 ELSE 0 END) AS missing_records_filled,
       sum(CASE WHEN {' OR '.join(c + ' IS NULL' for c in s.READING_COLUMNS)} THEN 1 ELSE 0 END) * 100.0 / count(*) AS missing_pct,
       count(DISTINCT CAST(ts AS DATE)) AS days_with_readings,
       date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS clean_daily_records,
       CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date, 'kwh' AS target_column
FROM first f JOIN counts c ON c.meter_id = f.meter_id GROUP BY f.meter_id""",
)
def quality_report(spark, sf_dir):
    r = s.readings(spark, sf_dir)
    return cleaning.quality_report(r.withColumn("ts", F.date_trunc("hour", "ts")), s.READING_COLUMNS)


@query(
    "dataset_type, initial_records:i, invalid_times:i, duplicates:i, final_records:i, missing_records_filled:i, missing_pct:6, "
    "start_date:d, end_date:d, target_column, clean_records:i, null_cells:i",
    f"""WITH {s.SQL_READINGS},
h AS (SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS ts) FROM readings),
first AS (SELECT * FROM h WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY seq) = 1),
n AS (SELECT count(*) AS initial_records, count(*) - count(ts) AS invalid_times FROM h),
f AS (
  SELECT count(*) AS final_records, sum(CASE WHEN {' OR '.join(c + ' IS NULL' for c in s.READING_COLUMNS)} THEN 1 ELSE 0 END) AS missing_records_filled,
    CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date FROM first),
-- a cell stays null where its meter has no value at all
e AS (
  SELECT sum(CASE WHEN n = 0 THEN m ELSE 0 END) AS null_cells FROM (
    SELECT meter_id, count(*) AS m, unnest([{', '.join(f'count({c})' for c in s.READING_COLUMNS)}]) AS n FROM first GROUP BY 1))
SELECT 'minute' AS dataset_type, *, initial_records - invalid_times - final_records AS duplicates,
  missing_records_filled * 100.0 / final_records AS missing_pct, 'kwh' AS target_column, final_records AS clean_records FROM n, f, e""",
)
def cleaning_totals(spark, sf_dir):
    """The report of a cleaning pass over readings with copies, gaps and bad times, beside what the pass wrote."""
    r = s.readings(spark, sf_dir)
    bad = r.withColumn("ts", F.when(F.col("seq") % 11 != 0, F.date_trunc("hour", "ts")))
    clean, totals = cleaning.clean_observed(bad, s.READING_COLUMNS)
    path = scratch_path(spark, "clean")
    clean.write.parquet(path)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in s.READING_COLUMNS), F.lit(0))
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("clean_records"), nulls.alias("null_cells"))
    report = cleaning.totals_report(spark, totals)
    return report.withColumn("_all", F.lit(1)).join(written.withColumn("_all", F.lit(1)), "_all").drop("_all")


_ROLLUP = f"""{s.sql_interpolated(s.READING_COLUMNS)},
sums AS (
  SELECT meter_id, day, sum(active_power_kw) AS power_sum, avg(active_power_kw) AS power_mean, max(active_power_kw) AS power_max,
         min(active_power_kw) AS power_min, stddev_samp(active_power_kw) AS power_std,
         avg(reactive_power_kw) AS reactive_power_mean, avg(voltage) AS voltage_mean, avg(intensity) AS intensity_mean,
         sum(sub1_wh) AS sub1_wh, sum(sub2_wh) AS sub2_wh, sum(sub3_wh) AS sub3_wh
  FROM clean GROUP BY meter_id, day),
rollup_days AS (
  SELECT *, power_sum / 60.0 AS kwh,
         greatest(0.0, power_sum / 60.0 * 1000.0 - (sub1_wh + sub2_wh + sub3_wh)) AS remainder_wh
  FROM sums)"""
_ROLLUP_SPEC = (
    "meter_id, day:d, power_sum:7, power_mean:7, power_max:7, power_min:7, power_std:5, reactive_power_mean:7, "
    "voltage_mean:7, intensity_mean:7, sub1_wh:7, sub2_wh:7, sub3_wh:7, kwh:7, remainder_wh:6"
)


def rolled_up(spark, sf_dir):
    return rollup.resample_daily(cleaning.clean_readings(s.readings(spark, sf_dir)))


@query(_ROLLUP_SPEC, f"WITH {_ROLLUP} SELECT * FROM rollup_days")
def daily_rollup(spark, sf_dir):
    return rolled_up(spark, sf_dir)


@query(
    "meter_id, day:d, kwh:7, sub1_wh:7, power_mean:7, power_std:5",
    f"""WITH {_ROLLUP},
{s.sql_spine('rollup_days', 'spined', ('kwh', 'sub1_wh'), ('power_mean', 'power_std'))}
SELECT * FROM spined""",
)
def daily_spine(spark, sf_dir):
    return rollup.day_spine(rolled_up(spark, sf_dir), ["kwh", "sub1_wh"])


@query("meter_id, day:d, kwh:6, remainder_wh:6", f"WITH {s.SQL_METERED} SELECT * FROM metered")
def energy_remainder(spark, sf_dir):
    m = s.metered(spark, sf_dir).withColumn("power_sum", F.col("kwh") * 60.0).drop("kwh", "remainder_wh")
    return rollup.add_energy(m)


@query(
    "meter_id, day:d, kwh:7, previous_week_mean:7, change_pct:4",
    f"""WITH {_ROLLUP},
{s.sql_spine('rollup_days', 'spined', ('kwh',), ())},
m AS (SELECT *, avg(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS previous_week_mean FROM spined)
SELECT *, CASE WHEN previous_week_mean IS NOT NULL
       THEN (kwh - previous_week_mean) / greatest(0.001, previous_week_mean) * 100.0 END AS change_pct FROM m""",
)
def day_against_last_week(spark, sf_dir):
    """What each meter used per day, and how that compares with the week before."""
    from pyspark.sql import Window

    from ..functions.numeric import pct_change

    d = rollup.day_spine(rolled_up(spark, sf_dir).select("meter_id", "day", "kwh"), ["kwh"])
    week = Window.partitionBy("meter_id").orderBy("day").rowsBetween(-7, -1)
    return d.withColumn("previous_week_mean", F.avg("kwh").over(week)).withColumn(
        "change_pct", pct_change("kwh", "previous_week_mean")
    )


# A daily file with weather columns: dates that are none, copies that differ, cells without a value.
_TARGET = "Previous electricity consumption (kWh)"


def _daily_file(spark, sf_dir):
    w = s.weather(spark, sf_dir).withColumn("k", F.col("meter_id").cast("bigint") + F.dayofmonth("day"))
    copies = F.when(F.col("k") % 5 == 0, F.array(F.col("kwh"), F.col("kwh") * 2)).otherwise(F.array("kwh"))
    path = scratch_path(spark, "daily-csv")
    rows = w.select("meter_id", "day", "k", "temperature", "condition", F.explode(copies).alias("v"))
    cells = rows.select(
        "meter_id",
        F.when(F.col("k") % 11 == 0, "unknown").otherwise(F.date_format("day", "yyyy-MM-dd")).alias("Date"),
        F.col("temperature").alias("Temperature (C)"),
        F.col("condition").alias("Weather condition"),
        F.when(F.col("k") % 7 == 0, "?").otherwise(F.col("v").cast("string")).alias(_TARGET),
    )
    cells.write.option("header", True).csv(path)
    return prepare_daily(read_telemetry(spark, path), meter="meter_id")


_SQL_DAILY_FILE = f"""{s.SQL_WEATHER},
cells AS (
  SELECT meter_id, CASE WHEN k % 11 <> 0 THEN day END AS day, CASE WHEN k % 7 <> 0 THEN kwh * c END AS kwh, c
  FROM (SELECT *, CAST(meter_id AS BIGINT) + dayofmonth(day) AS k, unnest(CASE WHEN (CAST(meter_id AS BIGINT) + dayofmonth(day)) % 5 = 0 THEN [1, 2] ELSE [1] END) AS c FROM weather)),
once AS (SELECT * FROM cells WHERE day IS NOT NULL AND c = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY day) AS i FROM once),
sides AS (
  SELECT *, last_value(CASE WHEN kwh IS NOT NULL THEN i END IGNORE NULLS) OVER up AS pi, last_value(kwh IGNORE NULLS) OVER up AS pv,
    first_value(CASE WHEN kwh IS NOT NULL THEN i END IGNORE NULLS) OVER down AS ni, first_value(kwh IGNORE NULLS) OVER down AS nv FROM i
  WINDOW up AS (PARTITION BY meter_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY meter_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT meter_id, day, CASE WHEN kwh IS NOT NULL THEN kwh WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE coalesce(pv, nv) END AS kwh FROM sides)"""


@query(
    "meter_id, ts:t, kwh:6, day_of_month:i, day_of_week:i, day_name, is_weekend:i, month_name, quarter:i, day_of_year:i, lag_1_filled:6, lag_7_filled:6, trailing_mean_7:6",
    f"""WITH {_SQL_DAILY_FILE}, w AS (SELECT * FROM filled WHERE kwh IS NOT NULL)
SELECT meter_id, CAST(day AS TIMESTAMP) AS ts, kwh, dayofmonth(day) AS day_of_month, isodow(day) - 1 AS day_of_week, dayname(day) AS day_name,
  isodow(day) >= 6 AS is_weekend, strftime(day, '%b') AS month_name, quarter(day) AS quarter, dayofyear(day) AS day_of_year,
  coalesce(lag(kwh, 1) OVER m, CASE WHEN count(*) OVER (PARTITION BY meter_id) > 1 THEN first_value(kwh) OVER m END) AS lag_1_filled,
  coalesce(lag(kwh, 7) OVER m, CASE WHEN count(*) OVER (PARTITION BY meter_id) > 7 THEN first_value(kwh) OVER m END) AS lag_7_filled,
  avg(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_mean_7
FROM w WINDOW m AS (PARTITION BY meter_id ORDER BY day)""",
)
def daily_file(spark, sf_dir):
    """A written daily file with weather columns to the daily table: layout, dates and target are found, not named."""
    return _daily_file(spark, sf_dir)[0]


@query(
    "meter_id, dataset_type, initial_records:i, invalid_times:i, duplicates:i, final_records:i, missing_records_filled:i, start_date:d, end_date:d",
    f"""WITH {_SQL_DAILY_FILE}, f AS (
  SELECT meter_id, count(*) AS final_records, count(*) - count(kwh) AS missing_records_filled, min(day) AS start_date, max(day) AS end_date FROM once GROUP BY 1)
SELECT c.meter_id, 'daily' AS dataset_type, count(*) AS initial_records, count(*) - count(c.day) AS invalid_times,
  count(c.day) - coalesce(any_value(final_records), 0) AS duplicates, coalesce(any_value(final_records), 0) AS final_records,
  coalesce(any_value(missing_records_filled), 0) AS missing_records_filled, any_value(start_date) AS start_date, any_value(end_date) AS end_date
FROM cells c LEFT JOIN f ON f.meter_id = c.meter_id GROUP BY c.meter_id""",
)
def daily_file_report(spark, sf_dir):
    """The quality report of the same file."""
    return _daily_file(spark, sf_dir)[1]
