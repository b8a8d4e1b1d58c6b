"""Chronological splits and scaling bounds, as columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import DAY, KWH, METER


def split_chrono(df: DataFrame, ratio: float = 0.8, key=[METER], time=DAY, name="split") -> DataFrame:
    """Mark the first ``floor(ratio * n)`` rows of each series ``train``, the rest ``test``."""
    w = Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(time))
    return df.withColumn(name, F.when(i <= F.floor(n * F.lit(ratio)), "train").otherwise("test"))


def split_validation(train: DataFrame, ratio: float = 0.85, key=[METER], time=DAY) -> DataFrame:
    """Mark the first ``max(1, floor(ratio * n))`` train rows ``fit``, the rest ``validate``."""
    w = Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(time))
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    return train.withColumn("part", F.when(i <= cut, "fit").otherwise("validate"))


def effective_lookback(n: Column, lookback: int) -> Column:
    """A look-back of 40 % of the series or more shrinks to 15 %, at least 7."""
    return F.when(
        F.lit(lookback) >= n * 0.4, F.greatest(F.lit(7), F.floor(n * 0.15).cast("int"))
    ).otherwise(F.lit(lookback))


def scale_bounds(split: DataFrame, key=[METER], y=KWH, name="split") -> DataFrame:
    """Smallest and largest train value of each meter."""
    known = F.when(F.col(name) == "train", F.col(y))
    return split.groupBy(*key).agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
