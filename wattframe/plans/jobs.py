"""Whole jobs: train and publish, or fetch a published model."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import round_metrics
from ..operators.outlook import forecast_summary
from ..schema import FEATURES
from ..sources.registry import Version, commit, current, new_version
from ..sources.tables import load_model, read_run, save_model, write_forecast, write_run
from .forecast import forecast
from .models import Benchmark, benchmark


class Published(NamedTuple):
    """A model with the scaling bounds it was trained with: all a forecast needs."""

    name: str
    model: PipelineModel
    bounds: DataFrame


def train_job(
    daily: DataFrame,
    out: str,
    candidates: Mapping[str, Mapping] | None = None,
    horizon: int = 30,
    scale: bool = True,
    features: list[str] = FEATURES,
) -> Benchmark:
    """Benchmark the candidates, forecast with the best one, and publish models,
    metrics, importances, bounds, forecast and summary under ``out``."""
    run = benchmark(daily, candidates, scale=scale, features=features)
    best = run.best
    for name, model in run.models.items():
        save_model(model, f"{out}/models/{name}")
    save_model(run.models[best], f"{out}/models/best")
    fc = forecast(run.models[best], daily, horizon, run.bounds, best)
    write_forecast(fc, f"{out}/forecast", "parquet")
    published = daily.sparkSession.read.parquet(f"{out}/forecast")
    write_run(
        out,
        round_metrics(run.metrics),
        run.importances,
        bounds=run.bounds,
        summary=forecast_summary(published),
    )
    return run


def get_model(
    spark: SparkSession, registry: str, name: str, daily: DataFrame | None = None, candidates: Mapping[str, Mapping] | None = None
) -> Published:
    """The published model called ``name``, else the published best one, else a
    model trained now on ``daily``; with its bounds."""
    for which in (name, "best"):
        model = load_model(spark, f"{registry}/models/{which}")
        if model is not None:
            return Published(which, model, read_run(spark, registry, "bounds"))
    if daily is None:
        raise FileNotFoundError(f"no model in {registry} and no history to train on")
    run = benchmark(daily, candidates if candidates is not None else {name: {}})
    best = run.best
    return Published(best, run.models[best], run.bounds)


def publish(daily: DataFrame, registry: str, **options) -> Version:
    """``train_job`` into a new version of the registry, which becomes the current one when all is written."""
    version = new_version(registry)
    train_job(daily, version, **options)
    return commit(daily.sparkSession, registry, version)


def published(spark: SparkSession, registry: str, name: str = "best", version: Version | None = None) -> Published:
    """A model of the current (or the given) version, with the bounds of the same run."""
    found = version or current(spark, registry)
    if found is None:
        raise FileNotFoundError(f"nothing is published in {registry}")
    return get_model(spark, found.path, name)
