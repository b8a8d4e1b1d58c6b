import pytest
from pyspark.sql import functions as F

from wattframe.operators.features import engineer_features
from wattframe.streaming import (
    FeatureSink, RollupSink, UpsertSink, closed_days, daily_stream, dedup_stream, feature_stream, history_stream, keep_first_stream, latest, run_available,
)
from wattframe.streaming.rollups import as_days

SCHEMA = "meter_id STRING, ts TIMESTAMP, active_power_kw DOUBLE"


@pytest.fixture
def files(spark, tmp_path):
    """Hourly readings of two meters over 45 days, one file per nine days."""
    src = str(tmp_path / "in")
    df = spark.range(45 * 24 * 2).selectExpr(
        "IF(id % 2 = 0, 'a', 'b') AS meter_id",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id div 2 AS INT), 0, 0) AS ts",
        "cast(id % 13 AS DOUBLE) AS active_power_kw",
    )
    for i in range(5):
        lo, hi = f"date_add(date'2024-01-01', {9 * i})", f"date_add(date'2024-01-01', {9 * i + 9})"
        df.where(f"ts >= {lo} AND ts < {hi}").coalesce(1).write.mode("append").parquet(src)
    return src, df


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_update_mode_over_several_batches(spark, files, tmp_path):
    src, df = files
    out = str(tmp_path / "out")
    run_available(as_days(daily_stream(stream(spark, src), readings_per_hour=1)), "update", UpsertSink(out), checkpoint=str(tmp_path / "cp"))
    got = latest(spark, out, ["meter_id", "day"]).select("meter_id", "day", "kwh", "readings")
    want = df.groupBy("meter_id", F.to_date("ts").alias("day")).agg(F.sum("active_power_kw").alias("kwh"), F.count("*").alias("readings"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 90
    assert spark.read.parquet(out).select("batch").distinct().count() > 2


def test_features_over_several_batches_equal_batch_features(spark, files, tmp_path):
    src, df = files
    out = str(tmp_path / "out")
    run_available(as_days(daily_stream(stream(spark, src), readings_per_hour=1)), "append", FeatureSink(out), checkpoint=str(tmp_path / "cp"))
    got = spark.read.parquet(f"{out}/features").drop("batch")
    daily = df.groupBy("meter_id", F.to_date("ts").alias("day")).agg(F.sum("active_power_kw").alias("kwh"))
    closed = daily.where("day < date'2024-02-13'")  # the last day and the one before the watermark stay open
    want = engineer_features(closed)
    assert want.count() == got.count() == 2 * 13
    a = got.orderBy("meter_id", "date").toPandas()
    b = want.orderBy("meter_id", "date").toPandas()
    import pandas as pd

    pd.testing.assert_frame_equal(a[b.columns.tolist()], b)


def test_a_batch_that_runs_twice_changes_nothing(spark, series, tmp_path):
    sink = FeatureSink(str(tmp_path))
    first, second = series({"a": range(31)}), series({"a": range(3)}, "2024-02-01")
    sink(first, 0)
    sink(second, 1)
    once = spark.read.parquet(f"{tmp_path}/features").orderBy("date").toPandas()
    sink(second, 1)
    assert spark.read.parquet(f"{tmp_path}/features").orderBy("date").toPandas().equals(once) and len(once) == 4


def test_copies_across_batches(spark, files, tmp_path):
    src, df = files
    spark.read.parquet(src).where("ts < timestamp'2024-01-02 00:00:00'").coalesce(1).write.mode("append").parquet(src)
    out = str(tmp_path / "out")
    run_available(dedup_stream(stream(spark, src), delay="60 days"), "append", path=out, checkpoint=str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == df.count()


# ------------------------------------------------------------------ several batches


def test_features_by_state_over_several_batches(spark, tmp_path):
    import pandas as pd

    df = spark.range(45 * 2).selectExpr("IF(id % 2 = 0, 'a', 'b') AS meter_id", "date_add(date'2024-01-01', cast(id div 2 AS INT)) AS day", "cast(id * id % 13 AS DOUBLE) AS kwh", "1L AS readings")
    late = spark.range(33).selectExpr("'c' AS meter_id", "date_add(date'2024-02-20', cast(id AS INT)) AS day", "cast(id % 7 AS DOUBLE) AS kwh", "1L AS readings")
    src, out, cp = (str(tmp_path / x) for x in ("closed", "out", "cp"))
    batches = [df.where(f"dayofyear(day) > {lo} AND dayofyear(day) <= {hi}") for lo, hi in ((0, 12), (12, 32), (32, 60))]
    for batch in [*batches, late]:
        batch.orderBy(F.desc("day")).coalesce(1).write.mode("append").parquet(src)
        run_available(feature_stream(closed_days(spark, src)), "append", path=out, checkpoint=cp)
    a = spark.read.parquet(out).orderBy("meter_id", "date").toPandas()
    b = engineer_features(df.unionByName(late).drop("readings")).orderBy("meter_id", "date").toPandas()
    assert a.meter_id.value_counts().to_dict() == {"a": 15, "b": 15, "c": 3}
    pd.testing.assert_frame_equal(a[b.columns.tolist()], b, check_dtype=False)


def test_silent_meters_are_forgotten(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("closed", "out", "cp"))

    def days(*rows):
        df = spark.createDataFrame([(m, d, float(v)) for m, d, v in rows], "meter_id STRING, day STRING, kwh DOUBLE")
        df.selectExpr("meter_id", "date(day) AS day", "kwh", "1L AS readings").coalesce(1).write.mode("append").parquet(src)
        run_available(history_stream(closed_days(spark, src), 3, forget_after_days=10), "append", path=out, checkpoint=cp)

    days(("a", "2024-01-01", 1), ("b", "2024-01-01", 2))
    days(("b", "2024-01-08", 3))
    days(("a", "2024-01-09", 4), ("b", "2024-01-30", 5))
    days(("a", "2024-01-31", 6), ("b", "2024-01-31", 7), ("c", "2024-01-01", 8))
    got = {(r.meter_id, r.day.day): r.buf for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): [], ("b", 1): [], ("b", 8): [2.0], ("a", 9): [1.0], ("b", 30): [2.0, 3.0], ("a", 31): [], ("b", 31): [2.0, 3.0, 5.0]}


COPY = "meter_id STRING, ts TIMESTAMP, seq BIGINT, v DOUBLE"


def arrive(spark, src, *batches):
    for rows in batches:
        df = spark.createDataFrame([(m, t, s, float(s)) for m, t, s in rows], "meter_id STRING, ts STRING, seq BIGINT, v DOUBLE")
        df.selectExpr("meter_id", "timestamp(ts) AS ts", "seq", "v").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(COPY).option("maxFilesPerTrigger", 1).parquet(src)


def test_lowest_place_wins_whatever_the_order(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = arrive(
        spark,
        src,
        [("a", "2024-01-01", 9), ("a", "2024-01-02", 5), ("b", "2024-01-01", 2)],
        [("a", "2024-01-01", 3), ("a", "2024-01-03", 7), (None, "2024-01-02", 8)],
        [("a", "2024-01-01", 4), ("a", "2024-01-10", 11), (None, "2024-01-02", 1)],
        [("a", "2024-01-12", 12)],
        [("a", "2024-01-01", 1), ("b", "2024-01-01", 1), ("a", "2024-01-12", 10)],  # the first two are too late
    )
    run_available(keep_first_stream(s, "seq", delay="4 days"), "append", path=out, checkpoint=str(tmp_path / "cp"))
    got = sorted((r.meter_id or "", r.ts.day, r.seq, r.v) for r in spark.read.parquet(out).collect())
    assert got == [("", 2, 1, 1.0), ("a", 1, 3, 3.0), ("a", 2, 5, 5.0), ("a", 3, 7, 7.0), ("b", 1, 2, 2.0)]


def test_rollup_touches_the_days_of_new_files_only(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def run(*batches):
        run_available(arrive(spark, src, *batches), "append", RollupSink(out, "seq", y="v", readings_per_hour=1), checkpoint=cp)
        return {(r.meter_id, str(r.day)): (r.kwh, r.readings, r.batch) for r in spark.read.parquet(f"{out}/daily").collect()}

    first = run([("a", "2024-01-01 10:00:00", 5), ("a", "2024-01-02 10:00:00", 6)], [("b", "2024-01-02 11:00:00", 7), ("a", None, 8)])
    assert first == {("a", "2024-01-01"): (5.0, 1, 0), ("a", "2024-01-02"): (6.0, 1, 1), ("b", "2024-01-02"): (7.0, 1, 1)}
    assert run() == first  # nothing new
    # a copy of lower place and another reading, on one day
    again = run([("a", "2024-01-01 10:00:00", 4), ("a", "2024-01-01 12:00:00", 20)])
    assert again == {**first, ("a", "2024-01-01"): (24.0, 2, 2)}
    # a batch that runs twice
    sink = RollupSink(out, "seq", y="v", readings_per_hour=1)
    sink(spark.read.schema(COPY).parquet(src).where("seq IN (4, 20)"), 2)
    assert run() == again
