"""Question routing, facts, insights and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assistant as a
from ..operators.baselines import forecast_baseline
from ..operators.outlook import finish_forecast
from ..operators.reports import autocorr, hourly_profile
from . import standins as s
from .base import query
from .models import _SQL_METRICS, CALENDAR, SQL_CALENDAR, calendar_forest
from .outlook import SQL_SUMMARY, sql_ma_forecast

_SQL_INTENT = (
    "CASE "
    + " ".join(
        rf"WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])') THEN '{name}'"
        for name, words in a.INTENT_RULES
    )
    + " ELSE 'fallback' END AS intent"
)
_SQL_ROUTED = f"{s.SQL_UTTERANCES}, routed AS (SELECT conv_id, turn, meter_id, {_SQL_INTENT} FROM utterances)"


@query("conv_id:i, turn:i, meter_id, intent", f"WITH {_SQL_ROUTED} SELECT * FROM routed")
def intent_routing(spark, sf_dir):
    return a.route_intents(s.utterances(spark, sf_dir))


@query("intent, n:i", f"WITH {_SQL_ROUTED} SELECT intent, count(*) AS n FROM routed GROUP BY 1")
def intent_summary(spark, sf_dir):
    return a.intent_summary(a.route_intents(s.utterances(spark, sf_dir)))


def _facts(spark, sf_dir):
    d = s.daily(spark, sf_dir)
    return a.facts(d, finish_forecast(forecast_baseline(d, "ma", 30)))


_SQL_FACTS = f"""{s.SQL_DAILY}, {sql_ma_forecast()},
summary AS ({SQL_SUMMARY.format('ma_fc')}),
fw AS (SELECT meter_id, avg(forecast_kwh) FILTER (isodow(day) >= 6) AS forecast_weekend_mean,
              avg(forecast_kwh) FILTER (isodow(day) < 6) AS forecast_weekday_mean FROM ma_fc GROUP BY 1),
back AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) AS b FROM daily),
h AS (SELECT meter_id, count(*) AS days, min(day) AS start_date, max(day) AS end_date, avg(kwh) AS mean_kwh, max(kwh) AS max_kwh,
             arg_min(day, struct_pack(a := -kwh, b := day)) AS max_date, sum(kwh) / 1000.0 AS total_mwh,
             avg(kwh) FILTER (isodow(day) >= 6) AS weekend_mean, avg(kwh) FILTER (isodow(day) < 6) AS weekday_mean,
             avg(kwh) FILTER (b <= 14) AS recent_mean FROM back GROUP BY 1),
facts AS (
  SELECT h.*, (weekend_mean - weekday_mean) / greatest(0.001, weekday_mean) * 100.0 AS weekend_diff_pct,
         round(days / 365.25, 1) AS years, mean_kwh * 365.0 AS annual_kwh, mean_kwh * 365.0 * 0.15 AS saved_kwh,
         mean_kwh * 365.0 * 0.15 * 0.18 AS saved_money, mean_kwh * 365.0 * 0.15 * 0.42 AS saved_co2_kg,
         floor(mean_kwh * 365.0 * 0.15 * 0.42 / 21.7) AS trees, s.* EXCLUDE (meter_id),
         forecast_weekend_mean, forecast_weekday_mean,
         (expected_avg_kwh - recent_mean) / greatest(0.001, recent_mean) * 100.0 AS forecast_delta_pct
  FROM h JOIN summary s ON s.meter_id = h.meter_id JOIN fw ON fw.meter_id = h.meter_id)"""


@query(
    "meter_id, days:i, start_date:d, end_date:d, mean_kwh:6, max_kwh:2, max_date:d, total_mwh:6, weekend_mean:6, weekday_mean:6, "
    "recent_mean:6, weekend_diff_pct:4, years:1, annual_kwh:3, saved_kwh:3, saved_money:3, saved_co2_kg:3, trees:i, horizon_days:i, "
    "expected_avg_kwh:2, total_expected_kwh:2, max_forecast_kwh:2, max_forecast_date, min_forecast_kwh:2, min_forecast_date, "
    "forecast_weekend_mean:4, forecast_weekday_mean:4, forecast_delta_pct:4",
    f"WITH RECURSIVE {_SQL_FACTS} SELECT * FROM facts",
)
def facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@query(
    "meter_id, insight, value:4, reference:4, change_pct:4, moment, action",
    f"""WITH RECURSIVE {_SQL_FACTS},
p AS (SELECT *, lag(kwh, 7) OVER (PARTITION BY meter_id ORDER BY day) AS before FROM daily),
ac AS (SELECT meter_id, corr(kwh, before) AS r FROM p WHERE before IS NOT NULL GROUP BY 1)
SELECT meter_id, 'peak_surge' AS insight, max_forecast_kwh AS value, mean_kwh AS reference,
       (max_forecast_kwh - mean_kwh) / mean_kwh * 100.0 AS change_pct, max_forecast_date AS moment, 'shift_load_off_peak' AS action FROM facts
UNION ALL SELECT meter_id, 'weekend_pattern', weekend_mean, weekday_mean, weekend_diff_pct, NULL, 'spread_weekend_load' FROM facts
UNION ALL SELECT meter_id, 'trajectory', r, NULL, NULL, NULL, 'automate_standby' FROM ac""",
)
def insights(spark, sf_dir):
    habit = autocorr(s.daily(spark, sf_dir)).select("meter_id", "autocorr")
    return a.insights(_facts(spark, sf_dir).join(habit, "meter_id"))


_TEMPERATURE_SQL = """(hot_mean - mild_mean) / greatest(0.001, mild_mean) * 100.0"""


@query(
    "meter_id, insight, value:6, reference:6, change_pct:4, action",
    f"""WITH {s.SQL_WEATHER}, w AS (
SELECT meter_id, avg(kwh) FILTER (isodow(day) >= 6) AS weekend_mean, avg(kwh) FILTER (isodow(day) < 6) AS weekday_mean,
       avg(kwh) FILTER (temperature > 30) AS hot_mean, avg(kwh) FILTER (temperature <= 26) AS mild_mean FROM weather GROUP BY 1)
SELECT meter_id, 'weekend_pattern' AS insight, weekend_mean AS value, weekday_mean AS reference,
  CASE WHEN weekday_mean IS NOT NULL THEN (weekend_mean - weekday_mean) / greatest(0.001, weekday_mean) * 100.0 END AS change_pct,
  'spread_weekend_load' AS action FROM w
UNION ALL SELECT meter_id, 'temperature_sensitivity', hot_mean, mild_mean,
  CASE WHEN mild_mean IS NOT NULL THEN {_TEMPERATURE_SQL} END, 'adjust_set_point' FROM w""",
)
def weather_insights(spark, sf_dir):
    return a.insights(a.facts(s.weather(spark, sf_dir), temperature="temperature"))


def _json(path: str, kind: str = "double"):
    return F.get_json_object("answer", f"$.{path}").cast(kind).alias(path)


@query(
    "conv_id:i, turn:i, meter_id, intent, mean_kwh:6, saved_kwh:3, weekend_mean:6, expected_avg_kwh:2, max_forecast_date, start_date",
    f"""WITH RECURSIVE {_SQL_FACTS}, {_SQL_ROUTED}
SELECT conv_id, turn, r.meter_id, intent, CASE WHEN intent IN ('savings', 'historical', 'fallback') THEN mean_kwh END AS mean_kwh,
  CASE WHEN intent = 'savings' THEN saved_kwh END AS saved_kwh, CASE WHEN intent = 'weekend' THEN weekend_mean END AS weekend_mean,
  CASE WHEN intent IN ('forecast', 'fallback') THEN expected_avg_kwh END AS expected_avg_kwh,
  CASE WHEN intent IN ('peak', 'forecast', 'fallback') THEN max_forecast_date END AS max_forecast_date,
  CASE WHEN intent = 'historical' THEN strftime(start_date, '%Y-%m-%d') END AS start_date
FROM routed r LEFT JOIN facts f ON f.meter_id = r.meter_id""",
)
def answers(spark, sf_dir):
    routed = a.route_intents(s.utterances(spark, sf_dir)).drop("text")
    out = a.answer(routed, _facts(spark, sf_dir))
    return out.select(
        "conv_id", "turn", "meter_id", "intent", _json("mean_kwh"), _json("saved_kwh"), _json("weekend_mean"),
        _json("expected_avg_kwh"), _json("max_forecast_date", "string"), _json("start_date", "string"),
    )


_SQL_ALL_FACTS = f"""{_SQL_FACTS}, {s.SQL_HOUSES}, {s.SQL_POWER}, {SQL_CALENDAR.removeprefix(s.SQL_DAILY).lstrip(", ")},
shares AS (
  SELECT meter_id, sum(sub1_wh) / 10.0 / sum(kwh) AS kitchen_pct, sum(sub2_wh) / 10.0 / sum(kwh) AS laundry_pct, sum(sub3_wh) / 10.0 / sum(kwh) AS climate_pct,
    avg(kwh) FILTER (temperature > 30) AS hot_mean, avg(kwh) FILTER (temperature <= 26) AS mild_mean FROM houses GROUP BY 1),
hours AS (SELECT meter_id, hour, round(avg(active_power_kw), 9) AS m FROM power WHERE active_power_kw IS NOT NULL GROUP BY 1, 2),
ends_of_day AS (
  SELECT meter_id, arg_min(hour, struct_pack(a := -m, b := hour)) AS peak_hour, max(m) AS peak_hour_power_kw,
    arg_min(hour, struct_pack(a := m, b := hour)) AS min_hour FROM hours GROUP BY 1),
quality AS (SELECT {_SQL_METRICS} FROM scored)"""


@query(
    "conv_id:i, turn:i, meter_id, intent, unanswered:i, model, rmse:1, listed_features:i, importance:6, kitchen_pct:6, laundry_pct:6, climate_pct:6, "
    "other_pct:6, peak_hour:i, peak_hour_power_kw:6, min_hour:i, hot_mean:6, mild_mean:6, temperature_diff_pct:4, days:i",
    f"""WITH RECURSIVE {_SQL_ALL_FACTS}, {_SQL_ROUTED}
SELECT conv_id, turn, r.meter_id, intent, 0 AS unanswered,
  CASE WHEN intent = 'model' THEN 'random_forest' END AS model, CASE WHEN intent = 'model' THEN rmse END AS rmse,
  CASE WHEN intent = 'features' THEN {len(CALENDAR)} END AS listed_features, CASE WHEN intent = 'features' THEN 1.0 END AS importance,
  CASE WHEN intent = 'submetering' THEN kitchen_pct END AS kitchen_pct, CASE WHEN intent = 'submetering' THEN laundry_pct END AS laundry_pct,
  CASE WHEN intent = 'submetering' THEN climate_pct END AS climate_pct,
  CASE WHEN intent = 'submetering' THEN greatest(0.0, 100.0 - kitchen_pct - laundry_pct - climate_pct) END AS other_pct,
  CASE WHEN intent = 'schedule' THEN peak_hour END AS peak_hour, CASE WHEN intent = 'schedule' THEN peak_hour_power_kw END AS peak_hour_power_kw,
  CASE WHEN intent = 'schedule' THEN min_hour END AS min_hour, CASE WHEN intent = 'weather' THEN hot_mean END AS hot_mean,
  CASE WHEN intent = 'weather' THEN mild_mean END AS mild_mean, CASE WHEN intent = 'weather' THEN {_TEMPERATURE_SQL} END AS temperature_diff_pct,
  CASE WHEN intent IN ('greeting', 'historical') THEN days END AS days
FROM routed r JOIN facts f ON f.meter_id = r.meter_id JOIN shares sh ON sh.meter_id = r.meter_id JOIN ends_of_day e ON e.meter_id = r.meter_id, quality""",
)
def answers_all_intents(spark, sf_dir):
    """Every intent has figures: forecast, model, importances, sub-meters, hours and weather of each meter."""
    d, run = s.houses(spark, sf_dir), calendar_forest(spark, sf_dir)
    ahead = finish_forecast(forecast_baseline(d.select("meter_id", "day", "kwh"), "ma", 30))
    profile = hourly_profile(s.power(spark, sf_dir), places=(9, 9))
    known = a.facts(d, ahead, run.metrics, run.importances, "temperature", profile=profile)
    out = a.answer(a.route_intents(s.utterances(spark, sf_dir)).drop("text"), known)
    listed = F.from_json("answer", "top_features MAP<STRING, ARRAY<STRUCT<rank INT, feature STRING, importance DOUBLE>>>")["top_features"]["random_forest"]
    figures = ["kitchen_pct", "laundry_pct", "climate_pct", "other_pct", "peak_hour_power_kw", "hot_mean", "mild_mean", "temperature_diff_pct"]
    return out.select(
        "conv_id", "turn", "meter_id", "intent", (F.length(F.coalesce("answer", F.lit(""))) < 3).alias("unanswered"),
        F.get_json_object("answer", "$.best_model.model").alias("model"), F.get_json_object("answer", "$.best_model.rmse").alias("rmse"),
        F.when(listed.isNotNull(), F.size(listed)).alias("listed_features"),
        F.when(listed.isNotNull(), F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["importance"])).alias("importance"),
        *map(_json, figures), _json("peak_hour", "int"), _json("min_hour", "int"), _json("days", "int"),
    )
