"""Recursive forecasts: all meters advance together, one step at a time.

The state is one row per meter (last day, a buffer of at most ``n`` values, the
predictions so far). A step is a projection plus ``model.transform``: no shuffle.
The number of steps is the horizon (30 at most in normal use) and does not grow
with the data; a reliable checkpoint every few steps keeps the plan short.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import calendar_parts, cyclical_parts, future_days
from ..functions.numeric import clip0, min_max, min_max_inverse
from ..operators.baselines import history_buffer
from ..operators.features import make_sequences
from ..operators.outlook import finish_forecast
from ..operators.split import effective_lookback, scale_bounds, split_chrono
from ..schema import DAY, EPS_RATIO, FEATURES, HISTORY_ROWS, KWH, LAGS, METER, ROLLING_WINDOWS
from ..session import cut_lineage, materialise
from .models import TARGET, scale_feature

CHECKPOINT_EVERY = 5


def _recent(n: int) -> Column:
    return F.slice("buf", F.greatest(F.size("buf") - n, F.lit(0)) + 1, n)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def step_projections(ddof: int = 1) -> list[dict[str, Column]]:
    """Projections, applied in turn, that add the features of the day after the
    buffer. They refer to the state columns only, so one set serves every step.

    A short history gives its first value for a missing lag and statistics of
    what there is; the deviation of a single value is 0.
    """
    day = F.date_add("last_day", F.size("fc") + 1)
    lags = {
        f"lag_{k}": F.coalesce(F.try_element_at("buf", F.lit(-k)), F.element_at("buf", 1)) for k in LAGS
    }
    windows = {f"_w{n}": _recent(n) for n in ROLLING_WINDOWS}
    means, rest = {}, {}
    for n in ROLLING_WINDOWS:
        a, mean = F.col(f"_w{n}"), F.col(f"rolling_mean_{n}")
        means[f"rolling_mean_{n}"] = _sum(a) / F.size(a)
        squares = _sum(F.zip_with(a, a, lambda v, _: (v - mean) * (v - mean)))
        rest[f"rolling_std_{n}"] = F.when(F.size(a) > 1, F.sqrt(squares / (F.size(a) - ddof))).otherwise(0.0)
        rest[f"rolling_min_{n}"] = F.array_min(a)
        rest[f"rolling_max_{n}"] = F.array_max(a)
    rest["diff_lag1_lag2"] = F.col("lag_1") - F.col("lag_2")
    rest["diff_lag1_lag7"] = F.col("lag_1") - F.col("lag_7")
    rest["ratio_lag1_rolling7"] = F.col("lag_1") / (F.col("rolling_mean_7") + EPS_RATIO)
    return [{**calendar_parts(day), **cyclical_parts(day), **lags, **windows}, means, rest]


def _explode(state: DataFrame, key: list[str], time: str, name: str, horizon: int) -> DataFrame:
    pairs = F.arrays_zip(future_days("last_day", horizon).alias("d"), F.col("fc").alias("v"))
    rows = state.select(*key, F.posexplode(pairs))
    return finish_forecast(
        rows.select(
            *key,
            F.lit(name).alias("model"),
            F.lit(horizon).alias("horizon"),
            (F.col("pos") + 1).alias("step"),
            F.col("col.d").alias(time),
            clip0(F.col("col.v")).alias("forecast_kwh"),
        ),
        time,
    )


def _with_bounds(state: DataFrame, bounds: DataFrame, key: list[str]) -> DataFrame:
    on = [k for k in key if k in bounds.columns]
    own = {"lo": F.coalesce("lo", F.array_min("buf")), "hi": F.coalesce("hi", F.array_max("buf"))}
    return state.join(bounds.select(*on, "lo", "hi"), on, "left").withColumns(own)


def forecast(
    model: PipelineModel,
    daily: DataFrame,
    horizon: int = 30,
    bounds: DataFrame | None = None,
    name: str = "model",
    key=[METER],
    time=DAY,
    y=KWH,
    checkpoint_every: int = CHECKPOINT_EVERY,
) -> DataFrame:
    """Forecast every meter ``horizon`` days ahead, each prediction becoming part
    of the history of the next. ``bounds`` holds ``lo`` and ``hi`` per meter when
    the model was trained on scaled series; they join on the key columns they have, so
    that scenarios of a meter share them, and a meter without bounds takes the range of
    its own last values. Values are rounded in the result only.
    """
    state = history_buffer(daily, HISTORY_ROWS, key, time, y)
    if bounds is None:
        state = state.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    else:
        state = _with_bounds(state, bounds, key)
    state = state.withColumn("fc", F.array().cast("array<double>"))
    carried = [*key, "last_day", "lo", "hi"]
    projections = step_projections()
    inputs = [scale_feature(c, F.col(c)).cast("double").alias(c) for c in FEATURES]
    following = F.array(clip0(min_max_inverse("prediction", "lo", "hi")))
    advance = [F.concat(_recent(HISTORY_ROWS - 1), "_next").alias("buf"), F.concat("fc", "_next").alias("fc")]
    for step in range(1, horizon + 1):
        rows = state
        for p in projections:
            rows = rows.withColumns(p)
        scored = model.transform(rows.select(*carried, "buf", "fc", *inputs))
        state = scored.withColumn("_next", following).select(*carried, *advance)
        if step % checkpoint_every == 0 and step < horizon:
            state = cut_lineage(state)
    return _explode(state, key, time, name, horizon)


def forecast_horizons(model: PipelineModel, daily: DataFrame, horizons=(7, 14, 30), **options) -> DataFrame:
    """Several horizons from one run: the shorter ones are its first days."""
    longest = forecast(model, daily, max(horizons), **options)
    each = F.explode(F.array(*[F.lit(h) for h in horizons]))
    return longest.withColumn("horizon", each).where(F.col("step") <= F.col("horizon"))


# ------------------------------------------------------------ sequence models


def sequence_frame(
    daily: DataFrame, lookback: int = 30, ratio: float = 0.8, key=[METER], time=DAY, y=KWH
) -> tuple[DataFrame, DataFrame]:
    """Scaled windows with their split, and the bounds they were scaled with.

    Windows are cut before the split, so the first test row sees the last train
    values, and scaling knows train values only.
    """
    split = split_chrono(daily.select(*key, time, y), ratio, key, time)
    bounds = scale_bounds(split, key, y)
    seqs = make_sequences(split, lookback, key, time, y, extra=("split",))
    scaled = seqs.join(bounds, key).withColumns(
        {
            TARGET: min_max("label", "lo", "hi"),
            "scaled": F.transform("window", lambda v: min_max(v, "lo", "hi")),
        }
    )
    return scaled.withColumn("features", array_to_vector("scaled")), bounds


def fit_sequence(frame: DataFrame, estimator=None) -> Model:
    """Any regressor on the window vector; a ridge line by default."""
    est = estimator or LinearRegression(regParam=1e-3)
    est = est.setFeaturesCol("features").setLabelCol(TARGET).setPredictionCol("prediction")
    return est.fit(frame.where(F.col("split") == "train"))


def forecast_sequence(
    model: Model,
    daily: DataFrame,
    bounds: DataFrame,
    lookback: int = 30,
    horizon: int = 30,
    name: str = "sequence",
    key=[METER],
    time=DAY,
    y=KWH,
    checkpoint_every: int = CHECKPOINT_EVERY,
) -> DataFrame:
    """Roll the window of scaled values forward; values are clipped at the end only.

    A meter with fewer than ``lookback`` rows starts from its first value, held.
    """
    missing = F.array_repeat(F.get("buf", F.lit(0)), F.lit(lookback) - F.size("buf"))
    state = history_buffer(daily, lookback, key, time, y)
    state = (
        _with_bounds(state, bounds, key)
        .withColumn("buf", F.concat(missing, "buf"))
        .withColumns({"buf": F.transform("buf", lambda v: min_max(v, "lo", "hi")), "fc": F.array().cast("array<double>")})
    )
    carried = [*key, "last_day", "lo", "hi"]
    for step in range(1, horizon + 1):
        scored = model.transform(state.withColumn("features", array_to_vector("buf")))
        nxt = F.array("prediction")
        state = scored.select(
            *carried,
            F.concat(F.slice("buf", 2, lookback - 1), nxt).alias("buf"),
            F.concat("fc", nxt).alias("fc"),
        )
        if step % checkpoint_every == 0 and step < horizon:
            state = cut_lineage(state)
    state = state.withColumn("fc", F.transform("fc", lambda v: min_max_inverse(v, "lo", "hi")))
    return _explode(state, key, time, name, horizon)


# ------------------------------------------------------------ a look-back per meter


class LookbackModels(NamedTuple):
    """One model per look-back, and what each meter needs of them: ``lookback, lo, hi``."""

    models: dict[int, Model]
    meters: DataFrame


def window_mean(window: Column) -> Column:
    """One feature, the mean of a window, whatever its length."""
    return F.array(_sum(window) / F.size(window))


def lookback_frame(daily: DataFrame, lookback: int = 30, ratio: float = 0.8, features=None, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """``sequence_frame`` with windows as long as each meter's history allows, and ``lookback`` on each row.

    ``features`` turns a scaled window into the array a model reads; the window itself by default.
    A meter with no more rows than its look-back, or none to train on, has no row.
    """
    series = Window.partitionBy(*key)
    rows = daily.select(*key, time, y).where(F.col(y).isNotNull())
    split = split_chrono(rows, ratio, key, time)
    n = F.count(F.lit(1)).over(series)
    known = F.when(F.col("split") == "train", F.col(y))
    sized = split.withColumns({"lookback": effective_lookback(n, lookback), "lo": F.min(known).over(series), "hi": F.max(known).over(series)})
    # windows as long as the longest, then cut to the meter's own
    past = F.collect_list(y).over(series.orderBy(time).rowsBetween(-lookback, -1))
    seqs = sized.withColumn("window", past).where(F.size("window") >= F.col("lookback"))
    own = F.slice("window", F.size("window") - F.col("lookback") + 1, F.col("lookback"))
    scaled = seqs.withColumn("scaled", F.transform(own, lambda v: min_max(v, F.col("lo"), F.col("hi"))))
    made = F.col("scaled") if features is None else features(F.col("scaled"))
    return scaled.select(*key, time, F.col(y).alias("label"), "split", "lookback", "lo", "hi", min_max(y, "lo", "hi").alias(TARGET), made.alias("inputs"))


def fit_lookbacks(frame: DataFrame, estimator=None, key=[METER]) -> LookbackModels:
    """One model per look-back, each on all meters that have it; at most as many as the longest look-back is days."""
    frame = materialise(frame.withColumn("features", array_to_vector("inputs")).drop("inputs"), "look-backs")
    trained = frame.where(F.col("split") == "train")
    models = {}
    for r in sorted(trained.select("lookback").distinct().collect()):
        own = frame.where(F.col("lookback") == r.lookback)
        models[r.lookback] = fit_sequence(own, estimator.copy() if estimator is not None else None)
    can = trained.select(*key, "lookback", "lo", "hi").distinct()
    return LookbackModels(models, can)


def forecast_lookbacks(
    fitted: LookbackModels, daily: DataFrame, horizon: int = 30, name: str = "sequence", features=None, key=[METER], time=DAY, y=KWH,
    checkpoint_every: int = CHECKPOINT_EVERY,
) -> DataFrame:
    """All meters in one rollout, each with its own look-back and the model for it.

    A step scores the meters of each look-back with their model and stacks the parts.
    Meters that no model was trained for have no forecast (see ``with_fallback``).
    """
    longest = max(fitted.models, default=1)
    # held in columns that the longest look-back bounds; a shorter one keeps its own tail
    state = history_buffer(daily.where(F.col(y).isNotNull()), longest, key, time, y).join(fitted.meters, key)
    tail = F.slice("buf", F.greatest(F.size("buf") - F.col("lookback"), F.lit(0)) + 1, F.col("lookback"))
    scaled = F.transform(tail, lambda v: min_max(v, F.col("lo"), F.col("hi")))
    state = state.withColumns({"buf": scaled, "fc": F.array().cast("array<double>")})
    carried = [*key, "last_day", "lo", "hi", "lookback"]
    made = F.col("buf") if features is None else features(F.col("buf"))
    state = cut_lineage(state)
    tasks = state.rdd.getNumPartitions()
    for step in range(1, horizon + 1):
        parts = []
        for length, model in fitted.models.items():
            own = state.where(F.col("lookback") == length).withColumn("features", array_to_vector(made))
            nxt = F.array("prediction")
            advanced = F.concat(F.slice("buf", 2, length - 1), nxt) if length > 1 else nxt
            parts.append(model.transform(own).select(*carried, advanced.alias("buf"), F.concat("fc", nxt).alias("fc")))
        if not parts:
            break
        state = reduce(DataFrame.unionByName, parts).coalesce(tasks)  # a union has the tasks of all its parts
        if len(parts) > 1 or (step % checkpoint_every == 0 and step < horizon):
            state = cut_lineage(state)
    state = state.withColumn("fc", F.transform("fc", lambda v: min_max_inverse(v, F.col("lo"), F.col("hi"))))
    return _explode(state, key, time, name, horizon)
