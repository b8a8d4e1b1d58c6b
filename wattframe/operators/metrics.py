"""Errors of predictions and comparison of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schema import DAY, EPS_RATIO, METER


def actual_vs_predicted(test: DataFrame, *preds: DataFrame, key=[METER], time=DAY) -> DataFrame:
    """Put one or more prediction tables beside the actual values, by date."""
    return reduce(lambda a, b: a.join(b, [*key, time]), preds, test)


def error_metrics(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, R2 and MAPE in one aggregate, unrounded.

    R2 of a constant series is null.
    """
    a, p = F.col(y), F.col(yhat)
    err = a - p
    sst = F.regr_syy(a, a)
    return df.where(a.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(sst != 0, 1 - F.sum(err * err) / sst).alias("r2"),
        (F.avg(F.abs(err) / F.greatest(F.abs(a), F.lit(EPS_RATIO))) * 100.0).alias("mape"),
    )


def round_metrics(metrics: DataFrame) -> DataFrame:
    """The published precision: four places, two for the percentage."""
    return metrics.withColumns(
        {"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 4), "mape": F.round("mape", 2)}
    )


def compare_models(*metric_tables: DataFrame) -> DataFrame:
    """One table of all evaluations (baselines beside models)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), metric_tables)


def best_model(metrics: DataFrame, by: list[str] = []) -> DataFrame:
    """Lowest RMSE; on a tie the candidate listed first (``candidate_no``)."""
    order = F.struct(F.col("rmse"), F.col("candidate_no"))
    return metrics.groupBy(*by).agg(
        F.min_by("model", order).alias("model"),
        F.min("rmse").alias("rmse"),
    )
