"""Profiles, distributions, key figures and savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import day_type, hour_label, is_weekend
from ..functions.text import hour_of_text
from ..operators import features as f
from ..operators import reports as r
from ..operators import sketches as sk
from ..operators.savings import savings, savings_for
from ..session import scratch_path
from . import standins as s
from .base import query, table

_W = "OVER (PARTITION BY meter_id ORDER BY day)"

_SQL_PROFILE = f"""{s.SQL_READINGS},
by_hour AS (
  SELECT meter_id, hour(ts) AS hour, avg(active_power_kw) AS mean_power_kw, stddev_samp(active_power_kw) AS std_power_kw,
         max(active_power_kw) AS max_power_kw, min(active_power_kw) AS min_power_kw,
         avg(sub1_wh) AS sub1_kitchen_wh, avg(sub2_wh) AS sub2_laundry_wh, avg(sub3_wh) AS sub3_climate_wh
  FROM readings WHERE active_power_kw IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT DISTINCT meter_id, h.hour FROM by_hour, (SELECT unnest(range(24)) AS hour) h),
profile AS (
  SELECT g.meter_id, g.hour, printf('%02d:00', g.hour) AS hour_label, b.* EXCLUDE (meter_id, hour)
  FROM grid g LEFT JOIN by_hour b ON b.meter_id = g.meter_id AND b.hour = g.hour)"""


def _profile(spark, sf_dir):
    return r.hourly_profile(s.readings(spark, sf_dir), places=(12, 12))


@query(
    "meter_id, hour:i, hour_label, mean_power_kw:7, std_power_kw:5, max_power_kw:5, min_power_kw:5, "
    "sub1_kitchen_wh:7, sub2_laundry_wh:7, sub3_climate_wh:7",
    f"WITH {_SQL_PROFILE} SELECT * FROM profile",
)
def hourly_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(
    "meter_id, hour:i, hour_label, n:i",
    f"WITH {s.SQL_READINGS} SELECT meter_id, hour(ts) AS hour, printf('%02d:00', hour(ts)) AS hour_label, count(*) AS n FROM readings GROUP BY 1, 2, 3",
)
def hour_from_text(spark, sf_dir):
    text = s.readings(spark, sf_dir).select("meter_id", F.date_format("ts", "HH:mm:ss").alias("Time"))
    d = text.groupBy("meter_id", hour_of_text("Time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("hour_label", hour_label("hour"))


@query(
    "meter_id, peak_hour:i, peak_hour_label, peak_hour_power_kw:7, min_hour:i, min_hour_label, min_hour_power_kw:7",
    f"""WITH {_SQL_PROFILE},
known AS (SELECT * FROM profile WHERE mean_power_kw IS NOT NULL),
top AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY round(mean_power_kw, 9) DESC, hour) = 1),
low AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY round(mean_power_kw, 9), hour) = 1)
SELECT t.meter_id, t.hour AS peak_hour, t.hour_label AS peak_hour_label, t.mean_power_kw AS peak_hour_power_kw,
       l.hour AS min_hour, l.hour_label AS min_hour_label, l.mean_power_kw AS min_hour_power_kw
FROM top t JOIN low l ON l.meter_id = t.meter_id""",
)
def peak_hours(spark, sf_dir):
    return r.peak_hours(r.hourly_profile(s.readings(spark, sf_dir), places=(9, 9)))


@query(
    "meter_id, hour:i, mean_power_kw:7, lower_kw:5, upper_kw:5",
    f"""WITH {_SQL_PROFILE} SELECT *, CASE WHEN std_power_kw IS NOT NULL THEN greatest(0.0, mean_power_kw - std_power_kw) END AS lower_kw,
mean_power_kw + std_power_kw AS upper_kw FROM profile""",
)
def profile_envelope(spark, sf_dir):
    return r.profile_envelope(_profile(spark, sf_dir))


@query(
    "meter_id, zone, mean_power_kw:7, max_power_kw:7, hours:i",
    f"""WITH {_SQL_PROFILE}
SELECT meter_id, CASE WHEN hour BETWEEN 1 AND 4 THEN 'valley' WHEN hour BETWEEN 5 AND 17 THEN 'mid_day'
       WHEN hour BETWEEN 18 AND 21 THEN 'evening_peak' ELSE 'late_night' END AS zone,
       avg(mean_power_kw) AS mean_power_kw, max(mean_power_kw) AS max_power_kw, count(mean_power_kw) AS hours
FROM profile GROUP BY 1, 2""",
)
def load_zones(spark, sf_dir):
    return r.load_zones(_profile(spark, sf_dir))


@query(
    "meter_id, day_of_week:i, day_name, mean_kwh:6, std_kwh:2, days:i",
    f"""WITH {s.SQL_DAILY} SELECT meter_id, isodow(day) - 1 AS day_of_week, strftime(day, '%A') AS day_name,
avg(kwh) AS mean_kwh, stddev_samp(kwh) AS std_kwh, count(*) AS days FROM daily GROUP BY 1, 2, 3""",
)
def dow_stats(spark, sf_dir):
    return r.dow_stats(s.daily(spark, sf_dir))


_WEEKEND = """avg(kwh) FILTER (isodow(day) >= 6) AS weekend_mean, avg(kwh) FILTER (isodow(day) < 6) AS weekday_mean"""


@query(
    "meter_id, weekend_mean:6, weekday_mean:6, diff_pct:4",
    f"""WITH {s.SQL_DAILY}, m AS (SELECT meter_id, {_WEEKEND} FROM daily GROUP BY 1)
SELECT *, (weekend_mean - weekday_mean) / greatest(0.001, weekday_mean) * 100.0 AS diff_pct FROM m""",
)
def weekend_effect(spark, sf_dir):
    return r.weekend_effect(s.daily(spark, sf_dir))


_BOX = """count(kwh) AS n, min(kwh) AS min, max(kwh) AS max, quantile_cont(kwh, 0.25) AS q1,
quantile_cont(kwh, 0.5) AS median, quantile_cont(kwh, 0.75) AS q3"""
_FENCES = "q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence"
_BOX_SPEC = "n:i, min:6, q1:6, median:6, q3:6, max:6, lower_fence:6, upper_fence:6"
_DAY_TYPE = "CASE WHEN isodow(day) >= 6 THEN 'Weekend (Sat-Sun)' ELSE 'Weekday (Mon-Fri)' END"


@query(
    f"meter_id, month:i, month_name, {_BOX_SPEC}",
    f"""WITH {s.SQL_DAILY}, b AS (SELECT meter_id, month(day) AS month, strftime(day, '%b') AS month_name, {_BOX} FROM daily GROUP BY 1, 2, 3)
SELECT *, {_FENCES} FROM b""",
)
def monthly_box(spark, sf_dir):
    return r.monthly_box(s.daily(spark, sf_dir))


@query(
    f"meter_id, day_type, {_BOX_SPEC}",
    f"""WITH {s.SQL_DAILY}, b AS (SELECT meter_id, {_DAY_TYPE} AS day_type, {_BOX} FROM daily GROUP BY 1, 2)
SELECT *, {_FENCES} FROM b""",
)
def day_type_box(spark, sf_dir):
    return r.day_type_box(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, day_type, kwh:4, lower_fence:6, upper_fence:6",
    f"""WITH {s.SQL_REGIONAL}, t AS (SELECT *, {_DAY_TYPE} AS day_type FROM regional),
q AS (SELECT meter_id, day_type, quantile_cont(kwh, 0.25) AS q1, quantile_cont(kwh, 0.75) AS q3 FROM t GROUP BY 1, 2),
fences AS (SELECT *, {_FENCES} FROM q)
SELECT t.*, lower_fence, upper_fence FROM t JOIN fences f ON f.meter_id = t.meter_id AND f.day_type = t.day_type
WHERE kwh < lower_fence OR kwh > upper_fence""",
)
def outlier_days(spark, sf_dir):
    return r.outlier_days(s.regional(spark, sf_dir))


@query(
    f"meter_id, people:i, {_BOX_SPEC}",
    f"WITH {s.SQL_HOMES}, b AS (SELECT meter_id, people, {_BOX} FROM homes GROUP BY 1, 2) SELECT *, {_FENCES} FROM b",
)
def occupancy_box(spark, sf_dir):
    return r.occupancy_box(s.homes(spark, sf_dir))


@query(
    "meter_id, bin:i, bin_start:6, bin_end:6, days:i, mean:6, median:6",
    f"""WITH {s.SQL_DAILY},
b AS (SELECT meter_id, min(kwh) AS lo, max(kwh) AS hi, avg(kwh) AS mean, median(kwh) AS median FROM daily GROUP BY 1),
x AS (SELECT d.meter_id, lo, hi, mean, median,
             CASE WHEN hi = lo THEN 1 ELSE least(40, CAST(floor((kwh - lo) / (hi - lo) * 40) AS BIGINT) + 1) END AS bin
      FROM daily d JOIN b ON b.meter_id = d.meter_id)
SELECT meter_id, bin, lo + (hi - lo) / 40 * (bin - 1) AS bin_start, lo + (hi - lo) / 40 * bin AS bin_end,
       count(*) AS days, mean, median
FROM x GROUP BY meter_id, bin, lo, hi, mean, median""",
)
def histogram40(spark, sf_dir):
    return r.histogram(s.daily(spark, sf_dir))


@query(
    "meter_id, hot_mean:7, mild_mean:7, diff_pct:4",
    f"""WITH {s.SQL_WEATHER},
m AS (SELECT meter_id, avg(kwh) FILTER (temperature > 30) AS hot_mean, avg(kwh) FILTER (temperature <= 26) AS mild_mean FROM weather GROUP BY 1)
SELECT *, CASE WHEN mild_mean IS NOT NULL THEN (hot_mean - mild_mean) / greatest(0.001, mild_mean) * 100.0 END AS diff_pct FROM m""",
)
def temperature_effect(spark, sf_dir):
    return r.temperature_effect(s.weather(spark, sf_dir))


@query(
    "meter_id, day:d, kind, kwh:5",
    f"""WITH {s.SQL_WEATHER} SELECT *, 'hot' AS kind FROM weather WHERE temperature > 30 AND isodow(day) >= 6
UNION ALL SELECT *, 'mild' AS kind FROM weather WHERE temperature <= 26 AND isodow(day) < 6""",
)
def day_filters(spark, sf_dir):
    weekend = is_weekend("day") == 1
    kind = F.when(r.is_hot("temperature") & weekend, "hot").when(r.is_mild("temperature") & ~weekend, "mild")
    return s.weather(spark, sf_dir).withColumn("kind", kind).where(F.col("kind").isNotNull())


@query(
    "condition, n:i, slope:6, intercept:5, r2:6, corr:6",
    f"""WITH {s.SQL_WEATHER} SELECT condition, regr_count(kwh, temperature) AS n, regr_slope(kwh, temperature) AS slope,
regr_intercept(kwh, temperature) AS intercept, regr_r2(kwh, temperature) AS r2, corr(kwh, temperature) AS corr FROM weather GROUP BY 1""",
)
def weather_ols(spark, sf_dir):
    return r.ols(s.weather(spark, sf_dir), "temperature", by=["condition"])


_SHARES = """100.0 * sum(sub1_wh) / 1000.0 / sum(kwh) AS kitchen_pct, 100.0 * sum(sub2_wh) / 1000.0 / sum(kwh) AS laundry_pct,
100.0 * sum(sub3_wh) / 1000.0 / sum(kwh) AS climate_pct,
greatest(0.0, 100.0 - 100.0 * (sum(sub1_wh) + sum(sub2_wh) + sum(sub3_wh)) / 1000.0 / sum(kwh)) AS other_pct"""


@query(
    "meter_id, kitchen_pct:6, laundry_pct:6, climate_pct:6, other_pct:6",
    f"WITH {s.SQL_METERED} SELECT meter_id, {_SHARES} FROM metered GROUP BY 1",
)
def submeter_shares(spark, sf_dir):
    return r.submeter_shares(s.metered(spark, sf_dir))


@query(
    "meter_id, day:d, kitchen_kwh:6, laundry_kwh:6, climate_kwh:6, remainder_kwh:6",
    f"""WITH {s.SQL_METERED} SELECT meter_id, day,
{", ".join(f"avg({c}) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 1000.0 AS {n}_kwh"
for n, c in (("kitchen", "sub1_wh"), ("laundry", "sub2_wh"), ("climate", "sub3_wh"), ("remainder", "remainder_wh")))}
FROM metered""",
)
def submeter_trend(spark, sf_dir):
    return f.submeter_trend(s.metered(spark, sf_dir))


_KPIS = """count(*) AS days, min(day) AS start_date, max(day) AS end_date, avg(kwh) AS mean_kwh, max(kwh) AS max_kwh,
sum(kwh) / 1000.0 AS total_mwh"""
_KPI_SPEC = "meter_id, days:i, start_date:d, end_date:d, mean_kwh:6, max_kwh:4, max_date:d, total_mwh:6"


def _sql_kpis(t: str) -> str:
    return f"""k AS (SELECT meter_id, {_KPIS} FROM {t} GROUP BY 1),
kpi AS (SELECT k.*, (SELECT min(day) FROM {t} d WHERE d.meter_id = k.meter_id AND d.kwh = k.max_kwh) AS max_date FROM k)"""


@query(_KPI_SPEC, f"WITH {s.SQL_DAILY}, {_sql_kpis('daily')} SELECT * FROM kpi")
def kpis(spark, sf_dir):
    return r.kpis(s.daily(spark, sf_dir))


@query(_KPI_SPEC, f"WITH {s.SQL_REGIONAL}, {_sql_kpis('regional')} SELECT * FROM kpi")
def regional_kpis(spark, sf_dir):
    return r.kpis(s.regional(spark, sf_dir))


@query(
    "meter_id, recent_mean:6, rows:i",
    f"""WITH {s.SQL_HOMES}, n AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) AS back FROM homes)
SELECT meter_id, avg(kwh) AS recent_mean, count(*) AS rows FROM n WHERE back <= 14 GROUP BY 1""",
)
def recent_mean(spark, sf_dir):
    return r.recent_mean(s.homes(spark, sf_dir))


@query(
    "meter_id, first_day:d, last_day:d, days:i, years:1, mean_kwh:6, total_mwh:6",
    f"""WITH {s.SQL_DAILY} SELECT meter_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days,
round(count(*) / 365.25, 1) AS years, avg(kwh) AS mean_kwh, sum(kwh) / 1000.0 AS total_mwh FROM daily GROUP BY 1""",
)
def history_overview(spark, sf_dir):
    return r.history_overview(s.daily(spark, sf_dir))


@query(
    "meter_id, autocorr:6, pairs:i",
    f"""WITH {s.SQL_DAILY}, p AS (SELECT *, lag(kwh, 7) {_W} AS before FROM daily)
SELECT meter_id, corr(kwh, before) AS autocorr, count(before) AS pairs FROM p WHERE before IS NOT NULL GROUP BY 1""",
)
def autocorr7(spark, sf_dir):
    return r.autocorr(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, kwh:4, rank:i, label",
    f"""WITH {s.SQL_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY meter_id ORDER BY kwh DESC, day) AS rank FROM daily)
SELECT *, strftime(day, '%Y-%m-%d (%a)') AS label FROM n WHERE rank <= 10""",
)
def top_peak_days(spark, sf_dir):
    return r.top_peak_days(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, kwh:4",
    f"WITH {s.SQL_DAILY} SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY meter_id ORDER BY day DESC) <= 30",
)
def last_30_days(spark, sf_dir):
    return r.tail(s.daily(spark, sf_dir), 30)


@query(
    "meter_id, day:d, kwh:4, trailing_mean_7:6, trailing_mean_30:6",
    f"""WITH {s.SQL_HOMES} SELECT meter_id, day, kwh,
avg(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trailing_mean_7,
avg(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS trailing_mean_30 FROM homes""",
)
def consumption_trend(spark, sf_dir):
    return r.trend(s.homes(spark, sf_dir))


SCENARIOS = [(0.18, 15.0, 0.42), (0.25, 10.0, 0.42), (0.12, 30.0, 0.7)]


@query(
    "meter_id, tariff:4, pct:4, co2_factor:4, mean_kwh:6, annual_kwh:3, saved_kwh:3, saved_money:3, saved_co2_kg:3, trees:i",
    f"""WITH {s.SQL_DAILY}, m AS (SELECT meter_id, avg(kwh) AS mean_kwh FROM daily GROUP BY 1),
c AS (SELECT * FROM (VALUES {", ".join(str(tuple(map(float, c))) for c in SCENARIOS)}) v(tariff, pct, co2_factor)),
x AS (SELECT *, mean_kwh * 365.0 AS annual_kwh, mean_kwh * 365.0 * (CAST(pct AS DOUBLE) / 100.0) AS saved_kwh FROM m, c)
SELECT *, saved_kwh * CAST(tariff AS DOUBLE) AS saved_money, saved_kwh * CAST(co2_factor AS DOUBLE) AS saved_co2_kg,
       floor(saved_kwh * CAST(co2_factor AS DOUBLE) / 21.7) AS trees FROM x""",
)
def savings_scenarios(spark, sf_dir):
    return savings(s.daily(spark, sf_dir), SCENARIOS)


@query(
    "meter_id, tariff:2, pct:1, co2_factor:2, annual_kwh:4, saved_kwh:4, saved_money:4, saved_co2_kg:4, trees:i",
    f"""WITH {s.SQL_DAILY}, m AS (SELECT meter_id, avg(kwh) * 365.0 AS annual_kwh FROM daily GROUP BY 1),
t AS (SELECT DISTINCT 0.1 + n_nationkey / 100.0 AS tariff, 5.0 + n_regionkey AS pct, 0.2 + n_regionkey / 10.0 AS co2_factor FROM nation),
x AS (SELECT *, annual_kwh * (pct / 100.0) AS saved_kwh FROM m, t)
SELECT *, saved_kwh * tariff AS saved_money, saved_kwh * co2_factor AS saved_co2_kg, floor(saved_kwh * co2_factor / 21.7) AS trees FROM x""",
)
def savings_table(spark, sf_dir):
    """Every meter under the scenarios of a table: one tariff per nation, one target per region."""
    scenarios = table(spark, sf_dir, "nation").select(
        (0.1 + F.col("n_nationkey") / 100.0).alias("tariff"), (5.0 + F.col("n_regionkey")).alias("pct"), (0.2 + F.col("n_regionkey") / 10.0).alias("co2_factor")
    )
    return savings_for(s.daily(spark, sf_dir), scenarios)


_SQL_VALUES = f"""{s.SQL_READINGS}, v AS (
  SELECT meter_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS day, active_power_kw AS kw FROM readings WHERE active_power_kw IS NOT NULL),
typed AS (SELECT *, {_DAY_TYPE} AS day_type FROM v)"""


@query(
    "scope, part, n:i, min:6, max:6, q1_within:i, median_within:i, q3_within:i",
    f"""WITH {_SQL_VALUES}
SELECT meter_id AS scope, strftime(month, '%Y-%m') AS part, count(*) AS n, min(kw) AS min, max(kw) AS max, 1 AS q1_within, 1 AS median_within, 1 AS q3_within
FROM typed GROUP BY 1, 2
UNION ALL SELECT 'all meters', day_type, count(*), min(kw), max(kw), 1, 1, 1 FROM typed GROUP BY 1, 2""",
)
def reading_boxes(spark, sf_dir):
    """Quartiles of raw readings from stored sketches, each set against the exact rank of the value it gives."""
    r = s.readings(spark, sf_dir)
    path = scratch_path(spark, "sketches")
    sk.write_sketches(sk.quantile_sketches(r, "active_power_kw"), path)
    stored = sk.read_sketches(spark, path)
    month = F.date_format("month", "yyyy-MM")
    by_month = sk.box_from_sketches(stored.select(F.col("meter_id").alias("scope"), month.alias("part"), "n", "min", "max", "sketch"), ["scope", "part"])
    by_type = sk.box_from_sketches(stored.select(F.lit("all meters").alias("scope"), F.col("day_type").alias("part"), "n", "min", "max", "sketch"), ["scope", "part"])
    boxes = by_month.unionByName(by_type)
    kw = F.col("active_power_kw")
    known = r.where(kw.isNotNull())
    groups = F.array(
        F.struct(F.col("meter_id").alias("scope"), F.date_format("ts", "yyyy-MM").alias("part")),
        F.struct(F.lit("all meters").alias("scope"), day_type(F.to_date("ts")).alias("part")),
    )
    each = known.select(kw.alias("kw"), F.explode(groups).alias("g")).select("kw", "g.*").join(boxes, ["scope", "part"])
    asked = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ranks = each.groupBy("scope", "part").agg(
        F.first("n").alias("n"), F.first("min").alias("min"), F.first("max").alias("max"),
        *[F.count_if(F.col("kw") < F.col(q)).alias(f"{q}_below") for q in asked],
        *[F.count_if(F.col("kw") <= F.col(q)).alias(f"{q}_to") for q in asked],
    )
    e = sk.RANK_ERROR
    return ranks.withColumns({f"{q}_within": (F.col(f"{q}_below") / F.col("n") <= p + e) & (F.col(f"{q}_to") / F.col("n") >= p - e) for q, p in asked.items()})
