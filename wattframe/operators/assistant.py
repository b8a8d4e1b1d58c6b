"""Question routing and grounded answers over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import pct_change
from ..functions.text import contains_word, normalise
from ..schema import DAY, KWH, METER
from .outlook import summary_exprs, weekend_effect_exprs
from .reports import is_hot, is_mild, kpi_exprs, peak_hours, submeter_share_exprs, weekend_means
from .savings import CO2_PER_TREE, DEFAULT_CO2, DEFAULT_PCT, DEFAULT_TARIFF

# Intent -> keywords, in order of priority (the first match wins).
INTENT_RULES = [
    ("features", "feature|features|importance|importances|driver|drivers|influence|lag|rolling|variables"),
    (
        "model",
        "model|models|accuracy|metric|metrics|r2|r-squared|mae|rmse|mape|random forest|xgboost|lstm|algorithm|regressor",
    ),
    ("peak", "peak|peaks|surge|surges|spike|spikes|highest|max load|maximum"),
    ("submetering", "submetering|sub-metering|submeter|sub-meter|sub metering|kitchen|water heater"),
    (
        "schedule",
        "appliance|appliances|washing machine|washer|dryer|ev charging|charger|dishwasher|schedule|scheduling"
        "|diurnal|hourly|time of day|cheapest time|best time",
    ),
    ("weekend", "weekend|weekends|weekday|weekdays|saturday|sunday"),
    (
        "forecast",
        "forecast|forecasts|forecasted|forecasting|predict|prediction|predictions|predicted|future|next week"
        "|next month|upcoming|projected|projection",
    ),
    (
        "savings",
        "save|savings|saved|bill|bills|cost|costs|tariff|tariffs|dollar|dollars|carbon|emission|emissions|co2"
        "|reduce|reduction|money",
    ),
    ("weather", "weather|temperature|temp|occupancy|occupant|occupants|people|climate|ambient"),
    ("historical", "historical|history|past|baseline|total energy|monitored|average daily|average load|lifetime"),
    ("greeting", "hello|hi|hey|greetings|help|who are you|what can you do|about"),
]
FALLBACK = "fallback"


def route_intents(utterances: DataFrame, text: str = "text", rules=INTENT_RULES) -> DataFrame:
    """Add ``intent``: the first rule whose keyword occurs in the text."""
    q = F.col("_q")
    chain = reduce(
        lambda c, r: c.when(contains_word(q, r[1]), r[0]),
        rules[1:],
        F.when(contains_word(q, rules[0][1]), rules[0][0]),
    )
    return utterances.withColumn("_q", normalise(text)).withColumn("intent", chain.otherwise(FALLBACK)).drop("_q")


def intent_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def facts(
    daily: DataFrame,
    fc: DataFrame | None = None,
    metrics: DataFrame | None = None,
    importances: DataFrame | None = None,
    temperature: str | None = None,
    recent: int = 14,
    key=[METER],
    time=DAY,
    y=KWH,
    profile: DataFrame | None = None,
) -> DataFrame:
    """One row of figures per meter.

    Everything about the history comes from one shuffle: the window marks the
    recent rows, and the aggregate reuses its partitioning. ``fc`` is one rounded
    forecast (one model and horizon). ``metrics`` and ``importances`` are those
    of the pooled models, a handful of rows that are attached to every meter.
    ``profile`` holds the 24 rows of each meter that ``hourly_profile`` gives.
    """
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(time).desc()))
    we, wd = weekend_means(time, y)
    figures = {**kpi_exprs(time, y), "weekend_mean": we, "weekday_mean": wd}
    figures["recent_mean"] = F.avg(F.when(F.col("_back") <= recent, F.col(y)))
    if "sub1_wh" in daily.columns:
        figures.update(submeter_share_exprs(y))
    if temperature:
        figures["hot_mean"] = F.avg(F.when(is_hot(temperature), F.col(y)))
        figures["mild_mean"] = F.avg(F.when(is_mild(temperature), F.col(y)))
    # the join with the forecast drops null keys on its side; dropping them here
    # as well lets both sides read the same shuffle of the history
    for k in key:
        daily = daily.where(F.col(k).isNotNull())
    out = daily.withColumn("_back", back).groupBy(*key).agg(*[c.alias(n) for n, c in figures.items()])
    annual = F.col("mean_kwh") * 365.0
    saved = annual * (DEFAULT_PCT / 100.0)
    out = out.withColumns(
        {
            "weekend_diff_pct": pct_change("weekend_mean", "weekday_mean"),
            "years": F.round(F.col("days") / 365.25, 1),
            "annual_kwh": annual,
            "saved_kwh": saved,
            "saved_money": saved * DEFAULT_TARIFF,
            "saved_co2_kg": saved * DEFAULT_CO2,
            "trees": F.floor(saved * DEFAULT_CO2 / CO2_PER_TREE),
        }
    )
    if temperature:
        out = out.withColumn("temperature_diff_pct", pct_change("hot_mean", "mild_mean"))
    if fc is not None:
        ahead = {**summary_exprs(time)}
        for name, c in weekend_effect_exprs(time).items():
            ahead[f"forecast_{name}"] = c
        out = out.join(fc.groupBy(*key).agg(*[c.alias(n) for n, c in ahead.items()]), key, "left").withColumn(
            "forecast_delta_pct", pct_change("expected_avg_kwh", "recent_mean")
        )
    if profile is not None:
        out = out.join(peak_hours(profile, key), key, "left")
    if metrics is not None:
        best = metrics.agg(
            F.min_by(F.struct("model", "mae", "rmse", "r2", "mape"), F.struct("rmse", "candidate_no")).alias("best_model")
        )
        out = _attach(out, best, ["best_model"])
    if importances is not None:
        top = (
            importances.where(F.col("rank") <= 8)
            .groupBy("model")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))).alias("t"))
            .agg(F.map_from_entries(F.collect_list(F.struct("model", "t"))).alias("top_features"))
        )
        out = _attach(out, top, ["top_features"])
    return out


def _attach(df: DataFrame, one_row: DataFrame, cols: list[str]) -> DataFrame:
    """Put the columns of a one-row table beside every row (scalar subqueries)."""
    return df.withColumns({c: one_row.select(c).scalar() for c in cols})


# Which figures answer which intent.
ANSWER_FIGURES = {
    "features": ["top_features"],
    "model": ["best_model"],
    "peak": ["max_forecast_kwh", "max_forecast_date", "min_forecast_kwh", "min_forecast_date", "max_kwh", "max_date"],
    "submetering": ["kitchen_pct", "laundry_pct", "climate_pct", "other_pct"],
    "schedule": ["peak_hour", "peak_hour_power_kw", "min_hour", "min_hour_power_kw"],
    "weekend": ["weekend_mean", "weekday_mean", "weekend_diff_pct", "forecast_weekend_mean", "forecast_weekday_mean"],
    "forecast": [
        "horizon_days", "expected_avg_kwh", "total_expected_kwh", "recent_mean", "forecast_delta_pct",
        "max_forecast_kwh", "max_forecast_date",
    ],
    "savings": ["mean_kwh", "annual_kwh", "saved_kwh", "saved_money", "saved_co2_kg", "trees"],
    "weather": ["hot_mean", "mild_mean", "temperature_diff_pct"],
    "historical": ["start_date", "end_date", "days", "years", "mean_kwh", "total_mwh"],
    "greeting": ["days", "horizon_days"],
    FALLBACK: ["mean_kwh", "expected_avg_kwh", "max_forecast_kwh", "max_forecast_date"],
}


def answer(routed: DataFrame, facts_table: DataFrame, key=[METER], salts: int = 16) -> DataFrame:
    """Join each routed question to its meter's figures and keep, as JSON, those
    its intent asks for. Figures the table lacks are left out.

    The figures are rendered once per (meter, intent), not once per question.
    One meter may own a third of all questions, so both sides carry a salt: the
    small side is repeated ``salts`` times, a question picks one by its content.
    """
    have = set(facts_table.columns)
    rendered = F.create_map(
        *[
            x
            for intent, names in ANSWER_FIGURES.items()
            for x in (
                F.lit(intent),
                F.to_json(F.struct(*[F.col(n) for n in names if n in have]))
                if any(n in have for n in names)
                else F.lit("{}"),
            )
        ]
    )
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    small = facts_table.select(*key, rendered.alias("_answers")).withColumn("_salt", spread)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in routed.columns]), F.lit(salts)).cast("int")
    big = routed.withColumn("_salt", salt)
    return (
        big.join(small, [*key, "_salt"], "left")
        .withColumn("answer", F.col("_answers")[F.col("intent")])
        .drop("_salt", "_answers")
    )


def insights(facts_table: DataFrame, key=[METER]) -> DataFrame:
    """Up to four rows per meter: what stands out, the evidence, what to do."""
    have = set(facts_table.columns)

    def row(name: str, value, reference, change, when, action: str):
        return F.struct(
            F.lit(name).alias("insight"),
            value.cast("double").alias("value"),
            reference.cast("double").alias("reference"),
            change.cast("double").alias("change_pct"),
            when.cast("string").alias("moment"),
            F.lit(action).alias("action"),
        )

    none = F.lit(None)
    mean = F.col("mean_kwh")
    rows = []
    if "max_forecast_kwh" in have:
        peak = F.col("max_forecast_kwh")
        rise = F.when(mean != 0, (peak - mean) / mean * 100.0)
        rows.append(row("peak_surge", peak, mean, rise, F.col("max_forecast_date"), "shift_load_off_peak"))
    rows.append(
        row(
            "weekend_pattern", F.col("weekend_mean"), F.col("weekday_mean"), F.col("weekend_diff_pct"), none,
            "spread_weekend_load",
        )
    )
    if "hot_mean" in have:
        rows.append(
            row(
                "temperature_sensitivity", F.col("hot_mean"), F.col("mild_mean"), F.col("temperature_diff_pct"), none,
                "adjust_set_point",
            )
        )
    elif "climate_pct" in have:
        rows.append(row("thermal_base_load", F.col("climate_pct"), none, none, none, "lower_heater_set_point"))
    if "autocorr" in have:
        rows.append(row("trajectory", F.col("autocorr"), none, none, none, "automate_standby"))
    return facts_table.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.*")
