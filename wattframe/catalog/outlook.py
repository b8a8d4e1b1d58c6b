"""Baselines, errors, forecasts without a model and the tables built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as b
from ..operators import metrics as m
from ..operators import outlook as o
from ..operators.split import split_chrono
from . import standins as s
from .base import query
from .features import _SQL_SPLIT, _past

_W = "OVER (PARTITION BY meter_id ORDER BY day)"

_SQL_PERSISTENCE = f"""p_rows AS (
  SELECT * FROM (SELECT *, lag(kwh, 1) {_W} AS prediction FROM split) WHERE split = 'test' AND prediction IS NOT NULL)"""
_SQL_MA = f"""m_rows AS (
  SELECT * FROM (SELECT *, CASE WHEN count(kwh) {_past(7)} = 7 THEN avg(kwh) {_past(7)} END AS prediction FROM split)
  WHERE split = 'test' AND prediction IS NOT NULL)"""


def _split(spark, sf_dir):
    return split_chrono(s.daily(spark, sf_dir))


@query("meter_id, day:d, kwh:4, prediction:4", f"WITH {_SQL_SPLIT}, {_SQL_PERSISTENCE} SELECT * FROM p_rows")
def baseline_persistence(spark, sf_dir):
    return b.baseline_persistence(_split(spark, sf_dir))


@query("meter_id, day:d, kwh:4, prediction:6", f"WITH {_SQL_SPLIT}, {_SQL_MA} SELECT * FROM m_rows")
def baseline_ma7(spark, sf_dir):
    return b.baseline_ma(_split(spark, sf_dir))


@query(
    "meter_id, day:d, kwh:4, persistence:4, ma7:6",
    f"""WITH {_SQL_SPLIT}, {_SQL_PERSISTENCE}, {_SQL_MA}
SELECT p.meter_id, p.day, p.kwh, p.prediction AS persistence, m.prediction AS ma7
FROM p_rows p JOIN m_rows m ON m.meter_id = p.meter_id AND m.day = p.day""",
)
def actual_vs_predicted(spark, sf_dir):
    split = _split(spark, sf_dir)
    test = split.where(F.col("split") == "test").select("meter_id", "day", "kwh")
    one = b.baseline_persistence(split).select("meter_id", "day", F.col("prediction").alias("persistence"))
    two = b.baseline_ma(split).select("meter_id", "day", F.col("prediction").alias("ma7"))
    return m.actual_vs_predicted(test, one, two)


_SQL_METRICS = """count(*) AS n, avg(abs(kwh - prediction)) AS mae, sqrt(avg((kwh - prediction) * (kwh - prediction))) AS rmse,
1 - sum((kwh - prediction) * (kwh - prediction)) / nullif(regr_syy(kwh, kwh), 0) AS r2,
avg(abs(kwh - prediction) / greatest(abs(kwh), 0.00001)) * 100.0 AS mape, log10(1 + avg(abs(kwh - prediction) / greatest(abs(kwh), 0.00001)) * 100.0) AS mape_log10"""
# a day without energy makes the percentage huge; its logarithm keeps the digits that count
_METRIC_SPEC = "n:i, mae:3, rmse:3, r2:6, mape_log10:6"


def _evaluations(spark, sf_dir, by):
    split = _split(spark, sf_dir)
    tables = []
    for no, (name, fn) in enumerate((("persistence", b.baseline_persistence), ("ma7", b.baseline_ma))):
        scored = fn(split).withColumns({"model": F.lit(name), "candidate_no": F.lit(no)})
        tables.append(m.error_metrics(scored, "kwh", "prediction", [*by, "model", "candidate_no"]))
    return m.compare_models(*tables)


@query(
    f"meter_id, model, {_METRIC_SPEC}",
    f"""WITH {_SQL_SPLIT}, {_SQL_PERSISTENCE}, {_SQL_MA}
SELECT meter_id, 'persistence' AS model, {_SQL_METRICS} FROM p_rows GROUP BY 1
UNION ALL SELECT meter_id, 'ma7' AS model, {_SQL_METRICS} FROM m_rows GROUP BY 1""",
)
def baseline_metrics(spark, sf_dir):
    return _evaluations(spark, sf_dir, ["meter_id"]).withColumn("mape_log10", F.log10(1 + F.col("mape")))


@query(
    "model, rmse:3",
    f"""WITH {_SQL_SPLIT}, {_SQL_PERSISTENCE}, {_SQL_MA},
e AS (SELECT 'persistence' AS model, 0 AS no, {_SQL_METRICS} FROM p_rows
      UNION ALL SELECT 'ma7', 1, {_SQL_METRICS} FROM m_rows)
SELECT model, rmse FROM e ORDER BY rmse, no LIMIT 1""",
)
def model_comparison(spark, sf_dir):
    return m.best_model(_evaluations(spark, sf_dir, []))


def _persistence(spark, sf_dir, h=30):
    return o.finish_forecast(b.forecast_baseline(s.daily(spark, sf_dir), "persistence", h))


def _ma(spark, sf_dir, h=30):
    return o.finish_forecast(b.forecast_baseline(s.daily(spark, sf_dir), "ma", h))


def sql_ma_forecast(h: int = 30, daily: str = "daily", out: str = "ma_fc") -> str:
    """CTE: the 7-day mean rolled ``h`` days ahead (needs WITH RECURSIVE)."""
    return f"""{out}_last AS (
  SELECT meter_id, max(day) AS last_day, array_agg(kwh ORDER BY day) AS w
  FROM (SELECT * FROM {daily} QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) <= 7) GROUP BY 1),
{out}_roll AS (
  SELECT meter_id, last_day, 0 AS step, w, CAST(NULL AS DOUBLE) AS v FROM {out}_last
  UNION ALL
  SELECT meter_id, last_day, step + 1, list_append(w[2:7], list_avg(w)), list_avg(w) FROM {out}_roll WHERE step < {h}),
{out} AS (
  SELECT meter_id, 'ma' AS model, {h} AS horizon, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, round(v, 2) AS forecast_kwh
  FROM {out}_roll WHERE step > 0)"""


def sql_persistence_forecast(h: int = 30, daily: str = "daily", out: str = "p_fc") -> str:
    return f"""{out} AS (
  SELECT meter_id, 'persistence' AS model, {h} AS horizon, g.step, CAST(day + CAST(g.step AS INTEGER) AS DATE) AS day, round(kwh, 2) AS forecast_kwh
  FROM (SELECT * FROM {daily} QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) = 1) l,
       (SELECT unnest(range(1, {h} + 1)) AS step) g)"""


_FC_SPEC = "meter_id, model, horizon:i, step:i, day:d, forecast_kwh:2, day_name, is_weekend:i"
_FC_COLUMNS = "*, strftime(day, '%A') AS day_name, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend"
_MA = f"WITH RECURSIVE {s.SQL_DAILY}, {sql_ma_forecast()}"
_P = f"WITH {s.SQL_DAILY}, {sql_persistence_forecast()}"


@query(_FC_SPEC, f"{_P} SELECT {_FC_COLUMNS} FROM p_fc")
def forecast_persistence_30(spark, sf_dir):
    return _persistence(spark, sf_dir)


@query(_FC_SPEC, f"{_MA} SELECT {_FC_COLUMNS} FROM ma_fc")
def forecast_ma7_30(spark, sf_dir):
    return _ma(spark, sf_dir)


SQL_SUMMARY = """SELECT meter_id, count(*) AS horizon_days, round(avg(forecast_kwh), 2) AS expected_avg_kwh,
       round(sum(forecast_kwh), 2) AS total_expected_kwh, max(forecast_kwh) AS max_forecast_kwh,
       strftime(arg_min(day, struct_pack(a := -forecast_kwh, b := day)), '%Y-%m-%d (%a)') AS max_forecast_date,
       min(forecast_kwh) AS min_forecast_kwh,
       strftime(arg_min(day, struct_pack(a := forecast_kwh, b := day)), '%Y-%m-%d (%a)') AS min_forecast_date
FROM {} GROUP BY meter_id"""


@query(
    "meter_id, horizon_days:i, expected_avg_kwh:2, total_expected_kwh:2, max_forecast_kwh:2, max_forecast_date, "
    "min_forecast_kwh:2, min_forecast_date",
    f"{_MA} {SQL_SUMMARY.format('ma_fc')}",
)
def forecast_summary(spark, sf_dir):
    return o.forecast_summary(_ma(spark, sf_dir))


@query(
    "meter_id, model, weekend_mean:4, weekday_mean:4",
    f"""{_MA} SELECT meter_id, model, coalesce(avg(forecast_kwh) FILTER (isodow(day) >= 6), avg(forecast_kwh)) AS weekend_mean,
coalesce(avg(forecast_kwh) FILTER (isodow(day) < 6), avg(forecast_kwh)) AS weekday_mean FROM ma_fc GROUP BY 1, 2""",
)
def forecast_weekend_effect(spark, sf_dir):
    return o.forecast_weekend_effect(_ma(spark, sf_dir))


@query("meter_id, model, slope:4", f"{_MA} SELECT meter_id, model, regr_slope(forecast_kwh, step - 1) AS slope FROM ma_fc GROUP BY 1, 2")
def forecast_slope(spark, sf_dir):
    return o.trend_slope(_ma(spark, sf_dir))


@query(
    "meter_id, day:d, forecast_kwh:2, lower_kwh:6, upper_kwh:6",
    f"{_MA} SELECT *, greatest(0.0, forecast_kwh * (1.0 - CAST(0.12 AS DOUBLE))) AS lower_kwh, forecast_kwh * (1.0 + CAST(0.12 AS DOUBLE)) AS upper_kwh FROM ma_fc",
)
def forecast_band(spark, sf_dir):
    return o.forecast_band(_ma(spark, sf_dir))


@query(
    "meter_id, day:d, forecast_kwh:2, historical_mean:6",
    f"""{_P}, h AS (SELECT meter_id, avg(kwh) AS historical_mean FROM daily GROUP BY 1)
SELECT f.*, historical_mean FROM p_fc f JOIN h ON h.meter_id = f.meter_id WHERE forecast_kwh > historical_mean * 1.25""",
)
def high_demand_days(spark, sf_dir):
    return o.high_demand_days(_persistence(spark, sf_dir), s.daily(spark, sf_dir))


@query(
    "meter_id, model, forecast_mean:4, historical_mean:6, delta_pct:4",
    f"""{_MA}, h AS (SELECT meter_id, avg(kwh) AS historical_mean FROM daily GROUP BY 1),
a AS (SELECT meter_id, model, avg(forecast_kwh) AS forecast_mean FROM ma_fc GROUP BY 1, 2)
SELECT a.*, historical_mean, (forecast_mean - historical_mean) / greatest(0.001, historical_mean) * 100.0 AS delta_pct
FROM a JOIN h ON h.meter_id = a.meter_id""",
)
def forecast_delta(spark, sf_dir):
    return o.forecast_delta(_ma(spark, sf_dir), s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, kwh:2, kind",
    f"""{_MA} SELECT meter_id, day, kwh, 'history' AS kind FROM daily
UNION ALL SELECT meter_id, day, forecast_kwh, 'forecast' FROM ma_fc""",
)
def history_and_forecast(spark, sf_dir):
    return o.history_and_forecast(s.daily(spark, sf_dir), _ma(spark, sf_dir))


@query(
    "meter_id, model, last_day:d, last_kwh:2, first_day:d, first_forecast_kwh:2",
    f"""{_MA} SELECT f.meter_id, model, d.day AS last_day, d.kwh AS last_kwh, f.day AS first_day, forecast_kwh AS first_forecast_kwh
FROM ma_fc f JOIN daily d ON d.meter_id = f.meter_id AND d.day = f.day - 1 WHERE step = 1""",
)
def forecast_bridge(spark, sf_dir):
    return o.bridge(s.daily(spark, sf_dir), _ma(spark, sf_dir))


@query(
    "meter_id, distance_kwh:2, days:i",
    f"""{_MA}, {sql_persistence_forecast()}
SELECT a.meter_id, sum(abs(a.forecast_kwh - b.forecast_kwh)) AS distance_kwh, count(*) AS days
FROM ma_fc a JOIN p_fc b ON b.meter_id = a.meter_id AND b.day = a.day GROUP BY 1""",
)
def forecast_distance(spark, sf_dir):
    return o.forecast_distance(_ma(spark, sf_dir), _persistence(spark, sf_dir))


@query(
    "meter_id, scenario:1, expected_avg_kwh:2, max_forecast_kwh:2",
    f"""WITH RECURSIVE {s.SQL_DAILY},
scaled AS (SELECT meter_id || '|' || c.f AS meter_id, day, kwh * CAST(c.f AS DOUBLE) AS kwh FROM daily, (VALUES ('1.0'), ('1.5')) c(f)),
{sql_ma_forecast(14, 'scaled')}
SELECT split_part(meter_id, '|', 1) AS meter_id, CAST(split_part(meter_id, '|', 2) AS DOUBLE) AS scenario,
       round(avg(forecast_kwh), 2) AS expected_avg_kwh, max(forecast_kwh) AS max_forecast_kwh FROM ma_fc GROUP BY 1, 2""",
)
def load_scenarios(spark, sf_dir):
    """The same rollout on the history as it is and at one and a half times the load."""
    d = o.scaled(s.daily(spark, sf_dir), [1.0, 1.5])
    key = ["meter_id", "scenario"]
    fc = o.finish_forecast(b.forecast_baseline(d, "ma", 14, key=key))
    return o.forecast_summary(fc, key)


@query(
    "meter_id, kind, horizon_days:i, expected_avg_kwh:2, total_expected_kwh:2, max_forecast_kwh:2, min_forecast_kwh:2",
    f"""WITH {s.SQL_DAILY} SELECT meter_id, 'history' AS kind, 30 AS horizon_days, avg(kwh) AS expected_avg_kwh,
avg(kwh) * 30 AS total_expected_kwh, max(kwh) AS max_forecast_kwh, min(kwh) AS min_forecast_kwh FROM daily GROUP BY 1""",
)
def fallback_summary(spark, sf_dir):
    return o.fallback_summary(s.daily(spark, sf_dir))
