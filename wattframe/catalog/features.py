"""Calendar, lag, rolling and sequence features; splits and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import cyclical_parts
from ..functions.numeric import min_max, min_max_inverse
from ..operators import features as f
from ..operators import split as sp
from ..operators.rollup import add_calendar
from ..operators.series import in_chunks
from ..schema import FEATURES, LAGS, ROLLING_WINDOWS
from . import standins as s
from .base import query, table

_W = "OVER (PARTITION BY meter_id ORDER BY day)"


def _past(n: int) -> str:
    return f"OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_SQL_CALENDAR = """CAST(day(day) AS BIGINT) AS day_of_month, isodow(day) - 1 AS day_of_week,
       CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, month(day) AS month, year(day) AS year,
       quarter(day) AS quarter, dayofyear(day) AS day_of_year"""
_SQL_CYCLICAL = """sin(2 * pi() * (isodow(day) - 1) / 7.0) AS sin_dow, cos(2 * pi() * (isodow(day) - 1) / 7.0) AS cos_dow,
       sin(2 * pi() * month(day) / 12.0) AS sin_month, cos(2 * pi() * month(day) / 12.0) AS cos_month"""
_SQL_LAGS = ", ".join(f"lag(kwh, {k}) {_W} AS lag_{k}" for k in LAGS)
_SQL_ROLLING = ",\n       ".join(
    f"CASE WHEN count(kwh) {_past(n)} = {n} THEN {fn}(kwh) {_past(n)} END AS rolling_{name}_{n}"
    for n in ROLLING_WINDOWS
    for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)
_SQL_MOMENTUM = """lag_1 - lag_2 AS diff_lag1_lag2, lag_1 - lag_7 AS diff_lag1_lag7,
       lag_1 / (rolling_mean_7 + 0.00001) AS ratio_lag1_rolling7"""
_SQL_FEATURES = f"""{s.SQL_DAILY},
windowed AS (SELECT *, {_SQL_LAGS}, {_SQL_ROLLING} FROM daily),
features AS (
  SELECT meter_id, day AS date, kwh, {_SQL_CALENDAR.replace('day_of_month', 'day')}, {_SQL_CYCLICAL},
         * EXCLUDE (meter_id, day, kwh), {_SQL_MOMENTUM}
  FROM windowed WHERE lag_30 IS NOT NULL)"""

_ROLLING_SPEC = ", ".join(
    f"rolling_mean_{n}:6, rolling_std_{n}:2, rolling_min_{n}:5, rolling_max_{n}:5" for n in ROLLING_WINDOWS
)
_LAG_SPEC = ", ".join(f"lag_{k}:5" for k in LAGS)


def _feature_kind(name: str) -> str:
    if name in ("day", "day_of_week", "is_weekend", "month", "year", "quarter", "day_of_year"):
        return "i"
    return "2" if name.startswith("rolling_std") else "5"


@query(
    "meter_id, day:d, day_of_month:i, day_of_week:i, is_weekend:i, month:i, year:i, quarter:i, day_of_year:i, day_name, month_name",
    f"WITH {s.SQL_DAILY} SELECT meter_id, day, {_SQL_CALENDAR}, strftime(day, '%A') AS day_name, strftime(day, '%b') AS month_name FROM daily",
)
def calendar_features(spark, sf_dir):
    return add_calendar(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, sin_dow:6, cos_dow:6, sin_month:6, cos_month:6",
    f"WITH {s.SQL_DAILY} SELECT meter_id, day, {_SQL_CYCLICAL} FROM daily",
)
def cyclical_features(spark, sf_dir):
    return s.daily(spark, sf_dir).withColumns(cyclical_parts("day"))


@query(f"meter_id, day:d, kwh:5, {_LAG_SPEC}", f"WITH {s.SQL_DAILY} SELECT *, {_SQL_LAGS} FROM daily")
def lag_features(spark, sf_dir):
    return f.add_lags(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, lag_1_filled:5, lag_7_filled:5, lag_500_filled:5",
    f"""WITH {s.SQL_HOMES},
n AS (SELECT *, count(*) OVER (PARTITION BY meter_id) AS n, first_value(kwh) {_W} AS first FROM homes)
SELECT meter_id, day, {", ".join(f"coalesce(lag(kwh, {k}) {_W}, CASE WHEN n > {k} THEN first END) AS lag_{k}_filled" for k in (1, 7, 500))}
FROM n""",
)
def filled_lags(spark, sf_dir):
    return f.add_filled_lags(s.homes(spark, sf_dir), (1, 7, 500))


@query(
    "meter_id, day:d, trailing_mean_7:6, trailing_mean_30:6",
    f"""WITH {s.SQL_DAILY} SELECT meter_id, day,
{", ".join(f"avg(kwh) OVER (PARTITION BY meter_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS trailing_mean_{n}" for n in (7, 30))}
FROM daily""",
)
def trailing_means(spark, sf_dir):
    return f.add_trailing_mean(s.daily(spark, sf_dir))


@query(f"meter_id, day:d, {_ROLLING_SPEC}", f"WITH {s.SQL_DAILY} SELECT meter_id, day, {_SQL_ROLLING} FROM daily")
def rolling_stats(spark, sf_dir):
    return f.add_rolling(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, diff_lag1_lag2:5, diff_lag1_lag7:5, ratio_lag1_rolling7:5",
    f"""WITH {s.SQL_DAILY}, w AS (SELECT *, {_SQL_LAGS}, {_SQL_ROLLING} FROM daily)
SELECT meter_id, day, {_SQL_MOMENTUM} FROM w""",
)
def momentum(spark, sf_dir):
    d = s.daily(spark, sf_dir)
    w = f.series_window(["meter_id"], "day")
    both = d.select("*", *[c.alias(n) for n, c in {**f.lag_exprs(w), **f.rolling_exprs(w)}.items()])
    return f.add_momentum(both)


@query(
    "meter_id, date:d, kwh:5, " + ", ".join(f"{c}:{_feature_kind(c)}" for c in FEATURES),
    f"WITH {_SQL_FEATURES} SELECT * FROM features",
)
def feature_matrix(spark, sf_dir):
    return f.engineer_features(s.daily(spark, sf_dir))


@query(
    "meter_id, event_id:i, lag_1:6, lag_30:6, rolling_mean_7:6",
    f"""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS meter_id, event_id, ts AS day, value AS kwh FROM events)
SELECT meter_id, event_id, lag(kwh, 1) {_W} AS lag_1, lag(kwh, 30) {_W} AS lag_30,
       CASE WHEN count(kwh) {_past(7)} = 7 THEN avg(kwh) {_past(7)} END AS rolling_mean_7
FROM t""",
)
def long_series_features(spark, sf_dir):
    """Look-back features of raw readings, each meter cut in exact chunks."""
    t = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("meter_id"), "event_id", "ts", F.col("value").alias("kwh")
    )

    def look_back(d, key):
        w = f.series_window(key, "ts")
        new = {**f.lag_exprs(w, "kwh", [1, 30]), **f.rolling_exprs(w, "kwh", [7])}
        return d.select("*", *[c.alias(n) for n, c in new.items()])

    return in_chunks(t, ["meter_id"], "ts", 30, look_back)


_SQL_SPLIT = f"""{s.SQL_DAILY},
split AS (
  SELECT *, CASE WHEN row_number() {_W} <= floor(count(*) OVER (PARTITION BY meter_id) * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM daily)"""


@query("meter_id, day:d, kwh:5, split", f"WITH {_SQL_SPLIT} SELECT * FROM split")
def chrono_split(spark, sf_dir):
    return sp.split_chrono(s.daily(spark, sf_dir))


@query(
    "meter_id, day:d, part",
    f"""WITH {_SQL_SPLIT}, train AS (SELECT * FROM split WHERE split = 'train')
SELECT meter_id, day, CASE WHEN row_number() {_W} <= greatest(1, floor(count(*) OVER (PARTITION BY meter_id) * 0.85))
       THEN 'fit' ELSE 'validate' END AS part FROM train""",
)
def validation_split(spark, sf_dir):
    d = sp.split_chrono(s.daily(spark, sf_dir))
    return sp.split_validation(d.where(F.col("split") == "train"))


@query(
    "meter_id, days:i, lookback:i",
    f"""WITH {s.SQL_HOMES}, n AS (SELECT meter_id, count(*) AS days FROM homes GROUP BY 1)
SELECT *, CASE WHEN 240 >= days * 0.4 THEN greatest(7, floor(days * 0.15)) ELSE 240 END AS lookback FROM n""",
)
def effective_lookback(spark, sf_dir):
    n = s.homes(spark, sf_dir).groupBy("meter_id").agg(F.count(F.lit(1)).alias("days"))
    return n.withColumn("lookback", sp.effective_lookback(F.col("days"), 240))


@query(
    "meter_id, day:d, label:5, window_size:i, oldest:5, newest:5, total:2, split",
    f"""WITH {_SQL_SPLIT},
w AS (SELECT *, count(*) {_past(14)} AS window_size, first_value(kwh) {_past(14)} AS oldest,
             last_value(kwh) {_past(14)} AS newest, sum(kwh) {_past(14)} AS total FROM split)
SELECT meter_id, day, kwh AS label, window_size, oldest, newest, total, split FROM w WHERE window_size = 14""",
)
def sequences(spark, sf_dir):
    """Windows are cut before the split: the first test row looks back on train rows."""
    seq = f.make_sequences(sp.split_chrono(s.daily(spark, sf_dir)), 14, extra=("split",))
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v)
    return seq.withColumns(
        {
            "window_size": F.size("window"),
            "oldest": F.element_at("window", 1),
            "newest": F.element_at("window", -1),
            "total": total,
        }
    )


@query(
    "meter_id, day:d, lo:5, hi:5, scaled:6, restored:4",
    f"""WITH {_SQL_SPLIT},
b AS (SELECT meter_id, min(kwh) AS lo, max(kwh) AS hi FROM split WHERE split = 'train' GROUP BY 1)
SELECT s.meter_id, day, lo, hi, (kwh - lo) / (hi - lo) AS scaled, kwh AS restored FROM split s JOIN b ON b.meter_id = s.meter_id""",
)
def minmax_scaled(spark, sf_dir):
    d = sp.split_chrono(s.daily(spark, sf_dir))
    scaled = d.join(sp.scale_bounds(d), "meter_id").withColumn("scaled", min_max("kwh", "lo", "hi"))
    return scaled.withColumn("restored", min_max_inverse("scaled", "lo", "hi"))
