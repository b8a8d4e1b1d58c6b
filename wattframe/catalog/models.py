"""Trained models, at the published settings.

SQL can check a tree model that reads one calendar column: its predictions are the
means of that column's groups, and later boosting rounds have nothing left to add.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.outlook import scaled, with_fallback
from ..plans import forecast as fc
from ..plans import models as mod
from ..plans.jobs import get_model, publish, published, train_job
from ..session import materialise, scratch_path
from ..sources.registry import new_version, versions
from . import standins as s
from .base import query
from .features import _SQL_LAGS

# All rows for every tree, so that groups have one mean; trees, depth and rounds are the published ones.
WHOLE_FOREST = {"random_forest": {"bootstrap": False}}
WHOLE_TREES = {**WHOLE_FOREST, "gbt": {"subsamplingRate": 1.0}, "gbt_wide": {"subsamplingRate": 1.0}}

_FC = "meter_id, model, horizon:i, step:i, day:d, forecast_kwh:2, day_name, is_weekend:i"


_W = "OVER (PARTITION BY meter_id ORDER BY day)"
_SQL_PARTS = f"""{s.SQL_DAILY},
lagged AS (SELECT *, {_SQL_LAGS} FROM daily),
usable AS (SELECT * FROM lagged WHERE lag_30 IS NOT NULL),
parts AS (
  SELECT *, CASE WHEN row_number() {_W} <= floor(count(*) OVER (PARTITION BY meter_id) * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM usable)"""
_SQL_SCALED = f"""{_SQL_PARTS},
bounds AS (SELECT meter_id, min(kwh) AS lo, max(kwh) AS hi FROM parts WHERE split = 'train' GROUP BY 1),
scaled AS (SELECT parts.*, lo, hi, (kwh - lo) / (hi - lo) AS z FROM parts JOIN bounds USING (meter_id))"""


def _sql_means(group: str) -> str:
    """CTEs ``means`` and ``scored``: what a tree model that reads ``group`` alone predicts."""
    return f"""{_SQL_SCALED},
means AS (SELECT {group} AS g, avg(z) AS m FROM scaled WHERE split = 'train' GROUP BY 1),
scored AS (
  SELECT meter_id, day AS date, kwh, greatest(0.0, m * (hi - lo) + lo) AS prediction
  FROM scaled JOIN means ON g = ({group}) WHERE split = 'test')"""


_SQL_METRICS = """count(*) AS n, avg(abs(kwh - prediction)) AS mae, sqrt(avg((kwh - prediction) * (kwh - prediction))) AS rmse,
1 - sum((kwh - prediction) * (kwh - prediction)) / regr_syy(kwh, kwh) AS r2"""


@query(_FC)
def rf_forecast(spark, sf_dir):
    d = s.daily(spark, sf_dir)
    run = mod.benchmark(d, {"random_forest": {}})
    return fc.forecast(run.best_fit, d, 30, run.bounds, "random_forest")


@query(
    "model, candidate_no:i, n:i, mae:2, rmse:2, r2:6",
    f"""WITH {_sql_means("isodow(day) >= 6")}
SELECT unnest(['random_forest', 'gbt', 'gbt_wide']) AS model, unnest([0, 1, 2]) AS candidate_no, * FROM (SELECT {_SQL_METRICS} FROM scored)""",
)
def gbt_benchmark(spark, sf_dir):
    """The three tree models on the weekend mark alone."""
    return mod.benchmark(s.daily(spark, sf_dir), WHOLE_TREES, features=["is_weekend"]).metrics


@query(
    "model, candidate_no:i, n:i, n_features:i, importance:6, ordered_errors:i",
    f"""WITH {_sql_means("isodow(day) >= 6")}
SELECT unnest(['random_forest', 'gbt', 'gbt_wide']) AS model, unnest([0, 1, 2]) AS candidate_no, n, 36 AS n_features, 1 AS importance, 1 AS ordered_errors
FROM (SELECT count(*) AS n FROM scored)""",
)
def gbt_benchmark_all_columns(spark, sf_dir):
    """The three tree models on all columns at published settings: rows and properties of their evaluation."""
    run = mod.benchmark(s.daily(spark, sf_dir))
    read = run.importances.groupBy("model").agg(F.count("feature").alias("n_features"), F.sum("importance").alias("importance"))
    return run.metrics.join(read, "model").withColumn("ordered_errors", F.expr("0 < mae AND mae <= rmse AND r2 < 1"))


@query("model, feature, importance:6, rank:i")
def importances(spark, sf_dir):
    frame = materialise(mod.training_frame(s.daily(spark, sf_dir)), "features")
    return mod.top_features(mod.importances(mod.fit(frame, "random_forest"), "random_forest"))


@query("meter_id, date:d, kwh:2, prediction:2")
def test_scores(spark, sf_dir):
    frame = materialise(mod.training_frame(s.daily(spark, sf_dir)), "features")
    return mod.score_test(mod.fit(frame, "linear"), frame)


@query("meter_id, date:d, kwh:2, prediction:1", f"WITH {_sql_means('isodow(day)')} SELECT * FROM scored")
def forest_scores(spark, sf_dir):
    frame = materialise(mod.training_frame(s.daily(spark, sf_dir)), "features")
    return mod.score_test(mod.fit(frame, "random_forest", ["day_of_week"], bootstrap=False), frame)


# Full depth separates the groups of several columns with few values; SQL numbers the groups.
CALENDAR = ["is_weekend", "quarter", "month"]
SQL_CALENDAR = _sql_means("month(day) + CASE WHEN isodow(day) >= 6 THEN 100 ELSE 0 END")


def calendar_forest(spark, sf_dir):
    """The forest on three calendar columns, evaluated."""
    return mod.benchmark(s.daily(spark, sf_dir), WHOLE_FOREST, features=CALENDAR)


@query("meter_id, date:d, kwh:2, prediction:1", f"WITH {SQL_CALENDAR} SELECT * FROM scored")
def forest_scores_by_calendar(spark, sf_dir):
    run = calendar_forest(spark, sf_dir)
    return mod.score_test(run.best_fit, run.frame)


@query(_FC)
def sequence_forecast(spark, sf_dir):
    d = s.daily(spark, sf_dir)
    frame, bounds = fc.sequence_frame(d, 30)
    return fc.forecast_sequence(fc.fit_sequence(frame), d, bounds, 30, 30)


@query(
    _FC,
    f"""WITH {_sql_means('isodow(day)')},
ends AS (SELECT meter_id, max(day) AS last_day, unnest([7, 14, 30]) AS horizon FROM daily GROUP BY 1),
ahead AS (SELECT *, unnest(range(1, horizon + 1)) AS step FROM ends),
dated AS (SELECT *, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day FROM ahead)
SELECT dated.meter_id, 'random_forest' AS model, horizon, step, day, greatest(0.0, m * (hi - lo) + lo) AS forecast_kwh,
  dayname(day) AS day_name, isodow(day) >= 6 AS is_weekend
FROM dated JOIN bounds USING (meter_id) JOIN means ON g = isodow(day)""",
)
def published_forecast(spark, sf_dir):
    """Train and publish; then fetch model and bounds by name and forecast all three horizons."""
    d, out = s.daily(spark, sf_dir), scratch_path(spark, "published")
    train_job(d, out, WHOLE_FOREST, features=["day_of_week"])
    found = get_model(spark, out, "random_forest")
    return fc.forecast_horizons(found.model, d, (7, 14, 30), bounds=found.bounds, name=found.name)


# A line on the previous day alone has a closed form, so SQL can check the whole
# way: features, split, fit, scores and both recursive rollouts.
LINE = {"linear": {"regParam": 0.0, "solver": "normal"}}
_SQL_LINE = f"""{_SQL_PARTS},
line AS (SELECT regr_slope(kwh, lag_1) AS b, regr_intercept(kwh, lag_1) AS a FROM parts WHERE split = 'train'),
scored AS (SELECT meter_id, day AS date, kwh, greatest(0.0, a + b * lag_1) AS prediction FROM parts, line WHERE split = 'test')"""


def _sql_line_rollout(h: int, line: str = "line") -> str:
    return f"""roll AS (
  SELECT meter_id, day AS last_day, 0 AS step, kwh AS v
  FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) = 1)
  UNION ALL
  SELECT meter_id, last_day, step + 1, greatest(0.0, a + b * v) FROM roll, {line} WHERE step < {h})
SELECT meter_id, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, v AS forecast_kwh FROM roll WHERE step > 0"""


def _line_run(spark, sf_dir):
    d = s.daily(spark, sf_dir)
    return d, mod.benchmark(d, LINE, scale=False, features=["lag_1"])


@query("meter_id, date:d, kwh:2, prediction:1", f"WITH {_SQL_LINE} SELECT * FROM scored")
def line_scores(spark, sf_dir):
    frame = materialise(mod.training_frame(s.daily(spark, sf_dir), scale=False), "features")
    return mod.score_test(mod.fit(frame, "linear", ["lag_1"], **LINE["linear"]), frame)


@query(
    "model, n:i, mae:2, rmse:2, r2:6",
    f"WITH {_SQL_LINE} SELECT 'linear' AS model, {_SQL_METRICS} FROM scored",
)
def line_benchmark(spark, sf_dir):
    return _line_run(spark, sf_dir)[1].metrics


@query("meter_id, step:i, day:d, forecast_kwh:2", f"WITH RECURSIVE {_SQL_LINE}, {_sql_line_rollout(30)}")
def line_forecast(spark, sf_dir):
    d, run = _line_run(spark, sf_dir)
    return fc.forecast(run.best_fit, d, 30, run.bounds, "linear")


@query(
    "meter_id, scenario:1, step:i, day:d, forecast_kwh:2",
    f"""WITH RECURSIVE {_SQL_SCALED},
line AS (
  SELECT regr_slope(z, (lag_1 - lo) / (hi - lo)) AS b, regr_intercept(z, (lag_1 - lo) / (hi - lo)) AS a FROM scaled WHERE split = 'train'),
roll AS (
  SELECT d.meter_id, scenario, day AS last_day, 0 AS step, lo, hi, kwh * scenario AS v
  FROM (SELECT *, unnest([1.0::DOUBLE, 1.5::DOUBLE]) AS scenario FROM daily QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) = 1) d
       JOIN bounds b ON b.meter_id = d.meter_id
  UNION ALL
  SELECT meter_id, scenario, last_day, step + 1, lo, hi, greatest(0.0, (a + b * (v - lo) / (hi - lo)) * (hi - lo) + lo) FROM roll, line WHERE step < 30)
SELECT meter_id, scenario, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, v AS forecast_kwh FROM roll WHERE step > 0""",
)
def scenario_forecast(spark, sf_dir):
    """One trained model on the history as it is and at one and a half times the load."""
    d = s.daily(spark, sf_dir)
    run = mod.benchmark(d, LINE, features=["lag_1"])
    return fc.forecast(run.best_fit, scaled(d, [1.0, 1.5]), 30, run.bounds, "linear", key=["meter_id", "scenario"])


_SQL_SEQUENCE = f"""{s.SQL_DAILY},
n AS (
  SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY meter_id) AS n, lag(kwh, 1) {_W} AS b1, lag(kwh, 2) {_W} AS b2 FROM daily),
train AS (SELECT * FROM n WHERE i <= floor(n * 0.8)),
bounds AS (SELECT meter_id, min(kwh) AS lo, max(kwh) AS hi FROM train GROUP BY 1),
z AS (
  SELECT (kwh - lo) / (hi - lo) AS z, (b1 - lo) / (hi - lo) AS x1, (b2 - lo) / (hi - lo) AS x2
  FROM train t JOIN bounds b ON b.meter_id = t.meter_id WHERE b2 IS NOT NULL),
c AS (
  SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, covar_pop(z, x1) AS c1, covar_pop(z, x2) AS c2,
    avg(z) AS mz, avg(x1) AS m1, avg(x2) AS m2 FROM z),
slopes AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS s1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS s2 FROM c),
line AS (SELECT s1, s2, mz - s1 * m1 - s2 * m2 AS a FROM slopes),
roll AS (
  SELECT d.meter_id, day AS last_day, 0 AS step, lo, hi, (kwh - lo) / (hi - lo) AS v, (b1 - lo) / (hi - lo) AS w
  FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) = 1) d JOIN bounds b ON b.meter_id = d.meter_id
  UNION ALL
  SELECT meter_id, last_day, step + 1, lo, hi, a + s1 * v + s2 * w, v FROM roll, line WHERE step < 30)"""


@query(
    "meter_id, step:i, day:d, forecast_kwh:2",
    f"""WITH RECURSIVE {_SQL_SEQUENCE}
SELECT meter_id, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, greatest(0.0, v * (hi - lo) + lo) AS forecast_kwh FROM roll WHERE step > 0""",
)
def sequence_line_forecast(spark, sf_dir):
    """A line on the two days before: the shortest look-back that has an order."""
    d = s.daily(spark, sf_dir)
    frame, bounds = fc.sequence_frame(d, 2)
    line = fc.fit_sequence(frame, mod.CANDIDATES["linear"](**LINE["linear"]))
    return fc.forecast_sequence(line, d, bounds, 2, 30)


# Meters of some 30 days beside meters of years; the windows of both are read by their mean, so that
# the line of each look-back has a closed form.


def _long_and_short(spark, sf_dir):
    short = s.weather(spark, sf_dir).select(F.concat(F.lit("user "), "meter_id").alias("meter_id"), "day", "kwh")
    return s.daily(spark, sf_dir).select("meter_id", "day", "kwh").unionByName(short)


_SQL_LOOKBACK = f"""{s.SQL_DAILY}, {s.SQL_WEATHER},
mixed AS (SELECT meter_id, day, kwh FROM daily UNION ALL SELECT 'user ' || meter_id, day, kwh FROM weather),
n AS (
  SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY meter_id) AS n, list(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar
  FROM mixed),
sized AS (SELECT *, CAST(CASE WHEN 30 >= n * 0.4 THEN greatest(7, floor(n * 0.15)) ELSE 30 END AS BIGINT) AS lb FROM n),
bounds AS (SELECT meter_id, min(kwh) AS lo, max(kwh) AS hi, if(max(kwh) = min(kwh), 1.0, max(kwh) - min(kwh)) AS width FROM sized WHERE i <= floor(n * 0.8) GROUP BY 1),
x AS (
  SELECT meter_id, lb, (kwh - lo) / width AS z, (list_avg(sofar[i - lb : i - 1]) - lo) / width AS x FROM sized JOIN bounds USING (meter_id)
  WHERE i > lb AND i <= floor(n * 0.8)),
line AS (SELECT lb, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM x GROUP BY lb),
roll AS (
  SELECT meter_id, lb, day AS last_day, 0 AS step, lo, width, a, b, list_transform(sofar[n - lb + 1 : n], lambda v: (v - lo) / width) AS buf, 0.0::DOUBLE AS v
  FROM sized JOIN bounds USING (meter_id) JOIN line USING (lb) WHERE i = n AND meter_id IN (SELECT meter_id FROM x)
  UNION ALL
  SELECT meter_id, lb, last_day, step + 1, lo, width, a, b, list_append(buf[2:], a + b * list_avg(buf)), a + b * list_avg(buf) FROM roll WHERE step < 14),
ahead AS (SELECT meter_id, lb, step, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS day, round(greatest(0.0, v * width + lo), 2) AS forecast_kwh FROM roll WHERE step > 0)"""


def _lookback_forecast(spark, sf_dir):
    d = materialise(_long_and_short(spark, sf_dir), "long-and-short")
    fitted = fc.fit_lookbacks(fc.lookback_frame(d, 30, features=fc.window_mean), mod.CANDIDATES["linear"](**LINE["linear"]))
    return d, fitted, fc.forecast_lookbacks(fitted, d, 14, features=fc.window_mean)


@query("meter_id, lookback:i, step:i, day:d, forecast_kwh:2", f"WITH RECURSIVE {_SQL_LOOKBACK} SELECT *, lb AS lookback FROM ahead")
def lookback_forecast(spark, sf_dir):
    """Meters of a month and of years in one rollout, each with its own look-back and the model for it."""
    _, fitted, ahead = _lookback_forecast(spark, sf_dir)
    return ahead.join(fitted.meters, "meter_id")


@query(
    "meter_id, kind, horizon_days:i, expected_avg_kwh:2, total_expected_kwh:2, max_forecast_kwh:2, min_forecast_kwh:2",
    f"""WITH RECURSIVE {_SQL_LOOKBACK}
SELECT meter_id, 'model' AS kind, count(*) AS horizon_days, avg(forecast_kwh) AS expected_avg_kwh, sum(forecast_kwh) AS total_expected_kwh,
  max(forecast_kwh) AS max_forecast_kwh, min(forecast_kwh) AS min_forecast_kwh FROM ahead GROUP BY 1
UNION ALL
SELECT meter_id, 'history', 14, avg(kwh), avg(kwh) * 14, max(kwh), min(kwh) FROM mixed WHERE meter_id NOT IN (SELECT meter_id FROM ahead) GROUP BY 1""",
)
def forecast_or_history(spark, sf_dir):
    """A summary for every meter: of its forecast, or of its history where it is too short for a model."""
    d, _, ahead = _lookback_forecast(spark, sf_dir)
    return with_fallback(ahead, d, 14)


@query(
    "meter_id, version:i, committed:i, step:i, day:d, forecast_kwh:2",
    f"SELECT *, 2 AS version, 2 AS committed FROM (WITH RECURSIVE {_SQL_LINE}, {_sql_line_rollout(14)}) AS r",
)
def registry_forecast(spark, sf_dir):
    """Two published runs and one that was not finished: models, bounds and metrics come from the second."""
    d, registry = s.daily(spark, sf_dir), scratch_path(spark, "registry")
    publish(d, registry, candidates={"linear": {"regParam": 10.0}}, features=["lag_1"], horizon=1)
    version = publish(d, registry, candidates=LINE, features=["lag_1"], scale=False, horizon=1)
    train_job(d, new_version(registry), {"linear": {"regParam": 5.0}}, features=["lag_1"], horizon=1)  # never committed
    found = published(spark, registry, "linear")
    ahead = fc.forecast(found.model, d, 14, found.bounds, found.name)
    return ahead.withColumns({"version": F.lit(version.number), "committed": F.lit(len(versions(spark, registry)))})
