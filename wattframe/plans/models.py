"""Training, scoring and comparison of regressors.

One pooled model serves all meters. Meters differ in size, so the series of each
meter is scaled to its own train range by default; with one meter, ``scale=False``
trains on plain kWh.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import clip0, min_max_inverse
from ..operators.features import engineer_features
from ..operators.metrics import best_model, compare_models, error_metrics
from ..operators.split import split_chrono
from ..schema import DAY, FEATURES, KWH, LEVEL_FEATURES, METER
from ..session import materialise

TARGET = "target"

# Settings of the candidates, in order of preference on ties.
CANDIDATES: dict[str, Callable[..., Estimator]] = {
    "random_forest": lambda **kw: RandomForestRegressor(
        **{"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "seed": 42, **kw}
    ),
    "gbt": lambda **kw: GBTRegressor(**{"maxIter": 150, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.85, "seed": 42, **kw}),
    "gbt_wide": lambda **kw: GBTRegressor(
        **{
            "maxIter": 200, "stepSize": 0.04, "maxDepth": 4, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
            "seed": 42, **kw,
        }
    ),
    "linear": lambda **kw: LinearRegression(**{"regParam": 1e-3, **kw}),
}
TREE_CANDIDATES = ("random_forest", "gbt", "gbt_wide")


def candidate(name: str, **settings) -> Estimator:
    """A configured estimator; ``settings`` override the defaults."""
    est = CANDIDATES[name](**settings)
    return est.setFeaturesCol("features").setLabelCol(TARGET).setPredictionCol("prediction")


def span(lo: str = "lo", hi: str = "hi") -> Column:
    return F.when(F.col(hi) == F.col(lo), F.lit(1.0)).otherwise(F.col(hi) - F.col(lo))


def scale_feature(name: str, value: Column) -> Column:
    """A level feature in units of the meter's train range; others unchanged.

    Values move by ``lo`` and shrink by the range; differences and deviations
    only shrink.
    """
    if name not in LEVEL_FEATURES:
        return value
    if name.startswith(("diff_", "rolling_std_")):
        return value / span()
    return (value - F.col("lo")) / span()


def training_frame(daily: DataFrame, ratio: float = 0.8, scale: bool = True, key=[METER], time=DAY, y=KWH) -> DataFrame:
    """Features, ``split``, ``target`` and the scaling bounds ``lo`` and ``hi``.

    Split and bounds use the partitioning of the feature window: one shuffle.
    """
    d = split_chrono(engineer_features(daily, key, time, y), ratio, key, "date")
    if scale:
        train_y = F.when(F.col("split") == "train", F.col(y))
        w = Window.partitionBy(*key)
        # a meter too short for a train row takes the range of all its rows
        d = d.withColumns({n: F.coalesce(f(train_y).over(w), f(y).over(w)) for n, f in (("lo", F.min), ("hi", F.max))})
    else:
        d = d.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    return d.select(
        *key,
        F.col("date").alias(time if time != "day" else "date"),
        y,
        "split",
        "lo",
        "hi",
        ((F.col(y) - F.col("lo")) / span()).alias(TARGET),
        *[scale_feature(c, F.col(c)).cast("double").alias(c) for c in FEATURES],
    )


def fit(frame: DataFrame, estimator: Estimator | str, features: list[str] = FEATURES, **settings) -> PipelineModel:
    """Fit any estimator with ``features`` and ``prediction`` columns on the train rows.

    Fitting reads the frame several times: pass a stored one (``materialise``).
    """
    if isinstance(estimator, str):
        estimator = candidate(estimator, **settings)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    train = frame.where(F.col("split") == "train")
    # trees cost far more than their rows: a frame of few files is dealt over all cores
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if train.rdd.getNumPartitions() < cores:
        train = train.repartition(cores)
    return Pipeline(stages=[assembler, estimator]).fit(train)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``prediction`` in kWh, not negative, for rows with features and bounds."""
    scored = model.transform(rows)
    return scored.withColumn("prediction", clip0(min_max_inverse("prediction", "lo", "hi"))).drop("features")


def score_test(model: PipelineModel, frame: DataFrame) -> DataFrame:
    return score(model, frame.where(F.col("split") == "test"))


def importances(model: PipelineModel, name: str) -> DataFrame:
    """Feature importances, highest first; no rows for a model without them.

    The frame has one row per feature, whatever the data size.
    """
    spark = SparkSession.active()
    last = model.stages[-1]
    values = last.featureImportances.toArray().tolist() if hasattr(last, "featureImportances") else []
    cols = model.stages[0].getInputCols()
    ordered = sorted(zip(cols, values), key=lambda p: (-p[1], p[0]))
    rows = [(name, c, float(v), i + 1) for i, (c, v) in enumerate(ordered)]
    return spark.createDataFrame(rows, "model STRING, feature STRING, importance DOUBLE, rank INT")


def top_features(imp: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` most important features of each model."""
    return imp.where(F.col("rank") <= n)


@dataclass
class Benchmark:
    """Fitted candidates with their evaluations."""

    frame: DataFrame
    metrics: DataFrame
    importances: DataFrame
    models: dict[str, PipelineModel] = field(default_factory=dict)

    @property
    def best(self) -> str:
        return best_model(self.metrics).head()["model"]

    @property
    def best_fit(self) -> PipelineModel:
        return self.models[self.best]

    @property
    def bounds(self) -> DataFrame:
        """Scaling bounds, one row per meter."""
        return self.frame.groupBy(METER).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def benchmark(
    daily: DataFrame,
    candidates: Mapping[str, Mapping] | None = None,
    ratio: float = 0.8,
    scale: bool = True,
    y: str = KWH,
    features: list[str] = FEATURES,
) -> Benchmark:
    """Fit all candidates on one train part and score them on one test part.

    The feature frame is written once and read by every fit. Scores are sums
    over the test rows; no prediction leaves the executors.
    """
    candidates = candidates if candidates is not None else {n: {} for n in TREE_CANDIDATES}
    frame = materialise(training_frame(daily, ratio, scale, y=y), "features")
    models, evaluations, imps = {}, [], []
    for no, (name, settings) in enumerate(candidates.items()):
        model = fit(frame, name, features, **settings)
        models[name] = model
        scored = score_test(model, frame).withColumns({"model": F.lit(name), "candidate_no": F.lit(no)})
        evaluations.append(error_metrics(scored, y, "prediction", ["model", "candidate_no"]))
        imps.append(importances(model, name))
    imp = imps[0]
    for other in imps[1:]:
        imp = imp.unionByName(other)
    # a few rows, stored so that no reader scores the test part again
    return Benchmark(frame, materialise(compare_models(*evaluations), "metrics"), imp, models)
