"""Sinks for ``foreachBatch``. Each writes one folder per batch and overwrites it
on a retry, so a batch that runs twice leaves the result of running once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.baselines import history_buffer
from ..operators.cleaning import dedup_first
from ..operators.features import engineer_features
from ..schema import DAY, KWH, METER, TS
from ..session import scratch_path


def run_available(stream: DataFrame, mode: str, sink=None, path: str | None = None, checkpoint: str | None = None) -> None:
    """Process what is there and stop: into ``sink`` (a ``foreachBatch`` function)
    or, in append mode, into Parquet files at ``path``."""
    spark = stream.sparkSession
    writer = (
        stream.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
    )
    writer = writer.foreachBatch(sink) if sink is not None else writer.format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()


@dataclass
class UpsertSink:
    """Keeps the changed rows of every batch of an update-mode query."""

    path: str

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row that an ``UpsertSink`` has kept."""
    kept = spark.read.parquet(path)
    values = [c for c in kept.columns if c not in (*keys, "batch")]
    return kept.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


@dataclass
class RollupSink:
    """Daily energy, kept up to date file by file.

    The stream's checkpoint is the list of files already read, so a batch holds new files
    only. Its readings go to ``readings``, by day and batch; the days they touch, and no
    others, are read back, cleared of copies and written over in ``daily``. A batch that
    runs twice overwrites its own folders, and a run without new files does nothing.
    """

    path: str
    tie: str
    y: str = "active_power_kw"
    readings_per_hour: int = 60

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(METER, TS, self.tie, self.y, F.to_date(TS).alias(DAY), F.lit(batch_id).alias("batch"))
        self._write(new.where(F.col(TS).isNotNull()), "readings", DAY, "batch")
        kept = spark.read.parquet(f"{self.path}/readings")
        touched = kept.where(F.col("batch") == batch_id).select(DAY).distinct()
        # a day read back is one that the batch brought: the others' folders are pruned
        again = dedup_first(kept.join(F.broadcast(touched), DAY, "left_semi"), [METER, TS], self.tie)  # one row per day
        daily = again.groupBy(METER, DAY).agg((F.sum(self.y) / float(self.readings_per_hour)).alias(KWH), F.count(self.y).alias("readings"))
        self._write(daily.withColumn("batch", F.lit(batch_id)), "daily", DAY)

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        out = df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(*by).parquet(f"{self.path}/{name}")


@dataclass
class FeatureSink:
    """Feature rows (and predictions) for days as they close.

    A snapshot holds the last 30 rows of each meter as one array, so a batch
    reads one row per meter instead of the history. Batch ``n`` reads snapshot
    ``n - 1`` and writes snapshot ``n``.
    """

    path: str
    model: object | None = None
    rows: int = 30

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(METER, DAY, KWH, F.lit(True).alias("_new"))
        rows = new
        if batch_id > 0:
            past = spark.read.parquet(f"{self.path}/snapshot/batch={batch_id - 1}")
            old = past.select(METER, F.explode("tail").alias("t")).select(
                METER, F.col("t.day").alias(DAY), F.col("t.kwh").alias(KWH), F.lit(False).alias("_new")
            )
            rows = old.unionByName(new)
        rows = rows.persist()
        try:
            features = engineer_features(rows, keep=("_new",)).where("_new").drop("_new")
            if self.model is not None:
                features = self.model.transform(features).drop("features")
            features.write.mode("overwrite").parquet(f"{self.path}/features/batch={batch_id}")
            self._tails(rows).write.mode("overwrite").parquet(f"{self.path}/snapshot/batch={batch_id}")
        finally:
            rows.unpersist()

    def _tails(self, rows: DataFrame) -> DataFrame:
        pairs = rows.select(METER, DAY, F.struct(DAY, KWH).alias("pair"))
        return history_buffer(pairs, self.rows, y="pair").select(METER, F.col("buf").alias("tail"))
