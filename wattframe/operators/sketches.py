"""Distributions of raw readings from stored quantile sketches.

An exact percentile needs all readings of a group in one task. A sketch has a fixed size,
is built on the map side and merges, so a store of one sketch per meter, month and day
type answers for any group made of these, and a new month adds its folder only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import day_type
from ..schema import METER, TS

#: Size of a sketch, and the distance between the rank that is asked for and the one that is given, at most.
SKETCH_K, RANK_ERROR = 800, 0.01


def quantile_sketches(readings: DataFrame, y: str, key: list[str] = [METER], time: str = TS, k: int = SKETCH_K) -> DataFrame:
    """``month, day_type, n, min, max, sketch`` per key: known values of ``y``, by month and day type.

    Rows without a time or a value count nowhere."""
    known = readings.where(F.col(time).isNotNull() & F.col(y).isNotNull())
    groups = [F.trunc(time, "month").alias("month"), day_type(F.to_date(time)).alias("day_type")]
    return known.groupBy(*key, *groups).agg(
        F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), F.kll_sketch_agg_double(F.col(y).cast("double"), k).alias("sketch")
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """One folder per month; months that are not given stay as they are."""
    out = sketches.hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("month").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def box_from_sketches(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """Count, extremes, quartiles and fences of the groups ``by``; quartiles within ``RANK_ERROR`` of their rank."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    at = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(rank)) for name, rank in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    d = merged.withColumns(at).drop("sketch")
    return d.withColumns(fences())


def fences() -> dict[str, Column]:
    q1, q3 = F.col("q1"), F.col("q3")
    return {"lower_fence": q1 - 1.5 * (q3 - q1), "upper_fence": q3 + 1.5 * (q3 - q1)}


def outlier_readings(readings: DataFrame, boxes: DataFrame, y: str, on: list[str]) -> DataFrame:
    """Readings outside the fences of their group; ``boxes`` has one row per group."""
    found = readings.join(boxes.select(*on, "lower_fence", "upper_fence"), on)
    return found.where((F.col(y) < F.col("lower_fence")) | (F.col(y) > F.col("upper_fence")))
