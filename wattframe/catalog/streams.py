"""Streaming queries, run to the end of the data that is there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from ..streaming import (
    FeatureSink, RollupSink, UpsertSink, closed_days, daily_stream, dedup_stream, feature_stream, keep_first_stream, latest, run_available,
    sliding_mean_stream,
)
from ..streaming.rollups import as_days
from .base import query, table
from .features import _SQL_LAGS, _SQL_ROLLING


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern: the table may be one file or a folder


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("meter_id"), "ts", F.col("value").alias("active_power_kw")
    )


@query(
    "meter_id, day:d, kwh:7, readings:i",
    """SELECT CAST(user_id AS VARCHAR) AS meter_id, CAST(ts AS DATE) AS day, sum(value) / 60.0 AS kwh, count(*) AS readings
FROM events GROUP BY 1, 2""",
)
def stream_daily(spark, sf_dir):
    path = scratch_path(spark, "stream-daily")
    run_available(as_days(daily_stream(_events(spark, sf_dir))), "update", UpsertSink(path))
    return latest(spark, path, ["meter_id", "day"])


@query(
    "meter_id, ts:t",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts FROM events",
)
def stream_dedup(spark, sf_dir):
    path = scratch_path(spark, "stream-dedup")
    hourly = _events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    run_available(dedup_stream(hourly, delay="2 days"), "append", path=path)
    return spark.read.parquet(path)


@query(
    "meter_id, first_day:d, until:d, mean_kwh:7, days:i",
    """WITH wm AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events),
d AS (SELECT CAST(user_id AS VARCHAR) AS meter_id, CAST(ts AS DATE) AS day, sum(value) / 60.0 AS kwh FROM events GROUP BY 1, 2),
closed AS (SELECT * FROM d, wm WHERE day + 1 <= wm),
spans AS (SELECT *, CAST(day - CAST(k AS INTEGER) AS DATE) AS first_day FROM closed, (SELECT unnest(range(7)) AS k))
SELECT meter_id, first_day, CAST(first_day + 7 AS DATE) AS until, avg(kwh) AS mean_kwh, count(*) AS days
FROM spans WHERE first_day + 7 <= wm GROUP BY 1, 2, 3""",
)
def stream_sliding_mean(spark, sf_dir):
    path = scratch_path(spark, "stream-sliding")
    run_available(sliding_mean_stream(daily_stream(_events(spark, sf_dir))), "append", path=path)
    return spark.read.parquet(path)


@query(
    "meter_id, date:d, kwh:6, lag_1:6, lag_30:6, rolling_mean_7:6, rolling_max_30:6",
    f"""WITH t AS (
SELECT o_orderpriority AS meter_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kwh FROM orders GROUP BY 1, 2),
daily AS (SELECT * FROM t WHERE day + 2 <= (SELECT max(day) FROM t)),
w AS (SELECT *, {_SQL_LAGS}, {_SQL_ROLLING} FROM daily)
SELECT *, day AS date FROM w WHERE lag_30 IS NOT NULL""",
)
def stream_features(spark, sf_dir):
    """Feature rows for every day the watermark has closed."""
    path = scratch_path(spark, "stream-features")
    orders = _stream(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("meter_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("active_power_kw")
    )
    closed = as_days(daily_stream(orders, readings_per_hour=1)).withColumn("kwh", F.round("kwh", 2))
    run_available(closed, "append", FeatureSink(path))
    return spark.read.parquet(f"{path}/features")


# ------------------------------------------------------------------ several batches

#: Arrivals that a table is read in.
ARRIVALS = 4


def _arrive(df: DataFrame, arrival, path: str) -> tuple[DataFrame, Iterator[int]]:
    """The rows as a stream that reads one ``arrival`` (0 to 3) at a time, and the steps that bring them."""
    files = max(1, df.rdd.getNumPartitions() // ARRIVALS)
    numbered = df.withColumn("_arrival", arrival)

    def bring():
        for i in range(ARRIVALS):
            numbered.where(F.col("_arrival") == i).drop("_arrival").repartition(files).write.mode("append").parquet(path)
            yield i

    steps = bring()
    next(steps)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path), steps


def _span(df: DataFrame):
    """Which quarter of the time span a row belongs to."""
    first, last = df.agg(F.min("ts"), F.max("ts")).head()
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(first))
    return F.least(F.lit(ARRIVALS - 1), F.floor(seconds * ARRIVALS / max(1.0, (last - first).total_seconds()))).cast("int")


@query(
    "meter_id, date:d, kwh:6, lag_1:6, lag_30:6, rolling_mean_7:6, rolling_std_14:5, rolling_max_30:6, ratio_lag1_rolling7:6, day:i, is_weekend:i",
    f"""WITH t AS (
SELECT o_orderpriority AS meter_id, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kwh FROM orders GROUP BY 1, 2),
daily AS (SELECT * FROM t WHERE day + 2 <= (SELECT max(day) FROM t)),
w AS (SELECT * EXCLUDE (day), day AS date, dayofmonth(day) AS day, isodow(day) >= 6 AS is_weekend, {_SQL_LAGS}, {_SQL_ROLLING} FROM daily)
SELECT *, lag_1 / (rolling_mean_7 + 0.00001) AS ratio_lag1_rolling7 FROM w WHERE lag_30 IS NOT NULL""",
)
def stream_features_keyed(spark, sf_dir):
    """Feature rows for closed days over four arrivals, from a list of days per meter in the state store."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("meter_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("active_power_kw")
    )
    path = scratch_path(spark, "stream-features-keyed")
    stream, more = _arrive(orders, _span(orders), f"{path}/in")
    days = as_days(daily_stream(stream, readings_per_hour=1)).withColumn("kwh", F.round("kwh", 2))
    while True:  # both streams stop and start again with every arrival
        run_available(days, "append", path=f"{path}/closed", checkpoint=f"{path}/closed-log")
        run_available(feature_stream(closed_days(spark, f"{path}/closed")), "append", path=f"{path}/features", checkpoint=f"{path}/features-log")
        if next(more, None) is None:
            return spark.read.parquet(f"{path}/features")


# An event arrives with its quarter of the time span; every fifth one a quarter later; every seventh
# one of the first days only with the last quarter, too late for a watermark of 12 days.
_SQL_ARRIVED = """span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM (SELECT date_trunc('hour', ts) AS ts FROM events)),
e AS (
  SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts, event_id AS seq, value AS active_power_kw,
         event_id % 7 = 0 AND date_trunc('hour', ts) < lo + INTERVAL 2 DAY AS late FROM events, span)"""


@query(
    "meter_id, ts:t, seq:i, active_power_kw:6",
    f"""WITH {_SQL_ARRIVED}
SELECT meter_id, ts, seq, active_power_kw FROM e, span WHERE NOT late AND ts <= hi - INTERVAL 12 DAY
QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY seq) = 1""",
)
def stream_keep_first(spark, sf_dir):
    """Copies that arrive out of order over four batches, some of them too late: the lowest place wins."""
    hourly = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("meter_id"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("active_power_kw"),
    )
    lo = hourly.agg(F.min("ts")).head()[0]
    late = (F.col("seq") % 7 == 0) & (F.col("ts") < F.lit(lo) + F.expr("INTERVAL 2 DAYS"))
    last = F.lit(ARRIVALS - 1)
    arrival = F.when(late, last).otherwise(F.least(_span(hourly) + F.when(F.col("seq") % 5 == 0, 1).otherwise(0), last))
    path = scratch_path(spark, "stream-keep-first")
    stream, more = _arrive(hourly, arrival, f"{path}/in")
    list(more)
    run_available(keep_first_stream(stream, "seq", delay="12 days"), "append", path=f"{path}/out")
    return spark.read.parquet(f"{path}/out")


@query(
    "meter_id, day:d, kwh:7, readings:i, batch:i",
    """WITH h AS (
  SELECT CAST(user_id AS VARCHAR) AS meter_id, date_trunc('hour', ts) AS ts, event_id AS seq, value AS v FROM events),
span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM h),
q AS (
  SELECT h.*, CAST(ts AS DATE) AS day,
    least(3, CAST(floor((epoch(ts) - epoch(lo)) * 4 / (epoch(hi) - epoch(lo))) AS INTEGER) + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END) AS arrival FROM h, span),
written AS (SELECT day, max(arrival) AS batch FROM q GROUP BY 1),
once AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY meter_id, ts ORDER BY seq) = 1)
SELECT meter_id, day, sum(v) / 60.0 AS kwh, count(v) AS readings, any_value(batch) AS batch FROM once JOIN written USING (day) GROUP BY 1, 2""",
)
def incremental_rollup(spark, sf_dir):
    """Daily energy kept up to date over four arrivals, copies among them; a day is written by the last batch that touched it."""
    hourly = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("meter_id"),
        F.date_trunc("hour", "ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("active_power_kw"),
    )
    arrival = F.least(_span(hourly) + F.when(F.col("seq") % 5 == 0, 1).otherwise(0), F.lit(ARRIVALS - 1))
    path = scratch_path(spark, "rollup")
    stream, more = _arrive(hourly, arrival, f"{path}/in")
    list(more)
    for _ in range(2):  # the second run finds no new file
        run_available(stream, "append", RollupSink(path, "seq"), checkpoint=f"{path}/log")
    return spark.read.parquet(f"{path}/daily")
