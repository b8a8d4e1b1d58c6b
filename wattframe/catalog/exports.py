"""Tables written and read back."""

from __future__ import annotations

from ..operators.baselines import forecast_baseline
from ..operators.metrics import round_metrics
from ..operators.outlook import finish_forecast
from ..operators.reports import hourly_profile
from ..session import scratch_path
from ..sources import tables as t
from ..sources.readers import first_available, read_telemetry
from . import standins as s
from .base import query
from .outlook import _FC_COLUMNS, _FC_SPEC, _P, _SQL_MA, _SQL_METRICS, _SQL_PERSISTENCE, _evaluations
from .features import _SQL_SPLIT
from .reports import _SQL_PROFILE


@query(_FC_SPEC, f"{_P} SELECT {_FC_COLUMNS} FROM p_fc")
def forecast_export(spark, sf_dir):
    """Forecast to CSV and back."""
    path = scratch_path(spark, "forecast")
    t.write_forecast(finish_forecast(forecast_baseline(s.daily(spark, sf_dir), "persistence", 30)), path)
    return read_telemetry(spark, path, sep=",", seq=None).selectExpr(
        "meter_id", "model", "int(horizon)", "int(step)", "date(day)", "double(forecast_kwh)", "day_name", "int(is_weekend)"
    )


@query(
    "meter_id, hour:i, hour_label, mean_power_kw:7, sub3_climate_wh:7",
    f"WITH {_SQL_PROFILE} SELECT * FROM profile",
)
def profile_saved(spark, sf_dir):
    path = scratch_path(spark, "profile")
    t.write_profile(hourly_profile(s.readings(spark, sf_dir), places=(12, 12)), path)
    return t.read_profile(spark, path)


@query(
    "model, n:i, mae:3, rmse:3",
    f"""WITH {_SQL_SPLIT}, {_SQL_PERSISTENCE}, {_SQL_MA} SELECT 'persistence' AS model, {_SQL_METRICS} FROM p_rows
UNION ALL SELECT 'ma7' AS model, {_SQL_METRICS} FROM m_rows""",
)
def run_saved(spark, sf_dir):
    path = scratch_path(spark, "run")
    t.write_run(path, round_metrics(_evaluations(spark, sf_dir, [])))
    return t.read_run(spark, path, "metrics")


@query("meter_id, day:d, kwh:2", f"WITH {s.SQL_DAILY} SELECT * FROM daily")
def daily_preferred(spark, sf_dir):
    """The stored daily table is taken before the raw files behind it."""
    stored = scratch_path(spark, "daily") + ".parquet"
    s.daily(spark, sf_dir).write.parquet(stored)
    _, df = first_available(spark, [f"{stored}.missing.parquet", stored, f"{sf_dir}/orders.parquet"])
    return df
