"""Column names and fixed values shared by every module."""

from __future__ import annotations

METER = "meter_id"
TS = "ts"
SEQ = "seq"
DAY = "day"
KWH = "kwh"

# Raw header -> our column, minute layout.
MINUTE_COLUMNS = {
    "Global_active_power": "active_power_kw",
    "Global_reactive_power": "reactive_power_kw",
    "Voltage": "voltage",
    "Global_intensity": "intensity",
    "Sub_metering_1": "sub1_wh",
    "Sub_metering_2": "sub2_wh",
    "Sub_metering_3": "sub3_wh",
}
READING_COLUMNS = list(MINUTE_COLUMNS.values())

# Texts that mean "no value" (the source's own markers, then the
# defaults of common CSV readers).
NULL_MARKERS = [
    "?", "NA", "null", "None", "",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NULL", "NaN", "n/a", "nan",
]

# Target names of a daily table, in order of preference.
TARGET_CANDIDATES = [
    "Previous electricity consumption (kWh)",
    "Daily_energy_kWh",
    "Electricity consumption (kWh)",
    "Consumption (kWh)",
    "consumption_kwh",
    "Power (kW)",
    "Appliance usage (kWh)",
]

CALENDAR_FEATURES = ["day", "day_of_week", "is_weekend", "month", "year", "quarter", "day_of_year"]
CYCLICAL_FEATURES = ["sin_dow", "cos_dow", "sin_month", "cos_month"]
LAGS = [1, 2, 3, 4, 5, 6, 7, 14, 21, 30]
ROLLING_WINDOWS = [7, 14, 30]
MOMENTUM_FEATURES = ["diff_lag1_lag2", "diff_lag1_lag7", "ratio_lag1_rolling7"]

# The model reads exactly these 36 columns, in this order.
FEATURES = (
    CALENDAR_FEATURES
    + CYCLICAL_FEATURES
    + [f"lag_{k}" for k in LAGS]
    + [f"rolling_{stat}_{n}" for n in ROLLING_WINDOWS for stat in ("mean", "std", "min", "max")]
    + MOMENTUM_FEATURES
)

# Features measured in the unit of the series; the rest are calendar values or
# ratios and stay as they are when a series is rescaled.
LEVEL_FEATURES = [c for c in FEATURES if c.startswith(("lag_", "rolling_", "diff_"))]

HISTORY_ROWS = max(LAGS)
EPS_PERCENT = 1e-3
EPS_RATIO = 1e-5
