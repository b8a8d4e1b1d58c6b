"""Writing and reading results: forecasts, profiles, runs, models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

PROFILE_SCHEMA = (
    "meter_id STRING, hour INT, hour_label STRING, mean_power_kw DOUBLE, std_power_kw DOUBLE, max_power_kw DOUBLE, "
    "min_power_kw DOUBLE, sub1_kitchen_wh DOUBLE, sub2_laundry_wh DOUBLE, sub3_climate_wh DOUBLE"
)


def write_forecast(fc: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = ("model",)) -> None:
    """One folder per model. A model is few files: rows are not gathered in one task."""
    out = fc.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.format(fmt).save(path)


def write_profile(profile: DataFrame, path: str, fmt: str = "json") -> None:
    profile.write.mode("overwrite").format(fmt).save(path)


def read_profile(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A saved profile. A missing one is an error: no stand-in values."""
    try:
        reader = spark.read.format(fmt)
        return (reader.schema(PROFILE_SCHEMA) if fmt == "json" else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no hourly profile at {path}; write one with write_profile") from e
        raise


def write_run(path: str, metrics: DataFrame, importances: DataFrame | None = None, **tables: DataFrame) -> None:
    """Metrics, importances and any further tables of a run, one folder each."""
    named = {"metrics": metrics, "importances": importances, **tables}
    for name, df in named.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def save_model(model: PipelineModel, path: str) -> None:
    """The assembler stage carries the feature order, so nothing else is saved."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved model, or ``None`` when there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return PipelineModel.load(path)
