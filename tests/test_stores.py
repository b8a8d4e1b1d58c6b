"""Stored sketches, versions of published runs, scenario tables, totals of a cleaning pass."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattframe.operators import sketches as sk
from wattframe.operators.cleaning import clean_observed, clean_readings, totals_report
from wattframe.operators.savings import savings, savings_for
from wattframe.plans.jobs import publish, published
from wattframe.sources import registry as reg


def test_sketches_keep_their_rank_error_through_merges(spark, tmp_path):
    path = str(tmp_path / "sketches")
    r = spark.range(120_000).selectExpr(
        "IF(id % 3 = 0, 'a', 'b') AS meter_id",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 1440 AS INT), 0, 0) AS ts",
        "cast(pmod(id * 7919, 120011) AS DOUBLE) AS kw",
    )
    r = r.unionByName(spark.sql("SELECT 'a' AS meter_id, CAST(NULL AS TIMESTAMP) AS ts, 1.0D AS kw UNION ALL SELECT 'c', timestamp'2024-01-05', NULL"))
    sk.write_sketches(sk.quantile_sketches(r, "kw"), path)
    box = sk.box_from_sketches(sk.read_sketches(spark, path), ["meter_id"])
    got = {x.meter_id: x for x in box.collect()}
    assert set(got) == {"a", "b"} and got["a"].n == 40_000 and got["b"].n == 80_000
    values = sorted(x.kw for x in r.where("meter_id = 'b'").collect())
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        rank = sum(v <= got["b"][name] for v in values) / len(values)
        assert abs(rank - p) <= sk.RANK_ERROR
    assert got["b"].lower_fence == got["b"].q1 - 1.5 * (got["b"].q3 - got["b"].q1)


def test_a_new_month_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "sketches")

    def write(month, *values):
        rows = spark.createDataFrame([("a", f"2024-{month:02d}-03 00:00:00", float(v)) for v in values], "meter_id STRING, ts STRING, kw DOUBLE")
        sk.write_sketches(sk.quantile_sketches(rows.selectExpr("meter_id", "timestamp(ts) AS ts", "kw"), "kw"), path)

    write(1, 1, 2, 3)
    write(2, 10, 20)
    write(2, 10, 20, 30)  # the month comes again
    months = {str(x.month): (x.n, x.median) for x in sk.box_from_sketches(sk.read_sketches(spark, path), ["month"]).collect()}
    assert months == {"2024-01-01": (3, 2.0), "2024-02-01": (3, 20.0)}
    (whole,) = sk.box_from_sketches(sk.read_sketches(spark, path), ["meter_id"]).collect()
    assert (whole.n, whole.min, whole.max) == (6, 1.0, 30.0)
    out = sk.outlier_readings(spark.sql("SELECT 'a' AS meter_id, explode(array(1D, 99D, NULL)) AS kw"), sk.box_from_sketches(sk.read_sketches(spark, path), ["meter_id"]), "kw", ["meter_id"])
    assert [x.kw for x in out.collect()] == [99.0]


def test_versions_are_seen_when_committed(spark, tmp_path):
    base = str(tmp_path / "registry")
    assert reg.current(spark, base) is None and reg.versions(spark, base) == []
    one, two, three = (reg.new_version(base) for _ in range(3))
    spark.range(1).write.parquet(f"{one}/t")
    assert reg.commit(spark, base, one).number == 1 and reg.current(spark, base).path == one
    spark.range(2).write.parquet(f"{two}/t")  # written and not committed
    assert reg.current(spark, base).path == one
    # a writer that took a number and died
    where, fs, _ = reg._files(spark, f"{base}/claims/{2:010d}")
    fs.create(where, False).close()
    assert reg.commit(spark, base, three).number == 3
    assert [v.path for v in reg.versions(spark, base)] == [one, three]
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path / "nothing"))


def test_published_models_come_with_their_own_bounds(spark, series, tmp_path):
    base = str(tmp_path / "registry")
    line = {"linear": {"regParam": 0.0, "solver": "normal"}}
    small = series({"a": [float(i % 9 + i / 50) for i in range(60)]})
    large = small.withColumn("kwh", F.col("kwh") * 10)
    old = publish(small, base, candidates=line, features=["lag_1"], horizon=3)
    new = publish(large, base, candidates=line, features=["lag_1"], horizon=3)
    a, b = published(spark, base, "linear", old), published(spark, base, "linear")
    assert (old.number, new.number) == (1, 2) and reg.current(spark, base) == new
    assert b.bounds.head().hi == pytest.approx(10 * a.bounds.head().hi)
    for kept in ("importances", "metrics", "bounds", "summary"):
        assert spark.read.parquet(f"{new.path}/{kept}").columns


def test_scenarios_of_a_table(spark, series):
    d = series({"a": [1.0, 2.0, 3.0], "b": [10.0]})
    table = spark.createDataFrame([(0.1, 5.0, 0.2), (0.2, 5.0, 0.2), (0.1, 5.0, 0.2), (None, 5.0, 0.2)], "tariff DOUBLE, pct DOUBLE, co2_factor DOUBLE")
    got = savings_for(d, table)
    want = savings(d, [(0.1, 5.0, 0.2), (0.2, 5.0, 0.2)])
    assert got.where("tariff IS NOT NULL").exceptAll(want).count() == 0 and got.count() == 6
    assert got.where("tariff IS NULL AND saved_money IS NULL AND saved_kwh > 0").count() == 2
    with pytest.raises(ValueError):
        savings_for(d, table, most=2)
    assert savings_for(d, table.limit(0)).count() == 0


def test_totals_come_with_the_cleaning_pass(readings, spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00", 1.0), ("a", 2, "2024-01-01 00:00:00", 9.0), ("a", 3, "2024-01-02 00:00:00", None), ("b", 4, None, 2.0), ("b", 5, "2024-01-03 00:00:00", 3.0)]
    raw = readings(rows)
    clean, totals = clean_observed(raw, ["active_power_kw"])
    plan = clean._jdf.queryExecution().toString()
    clean.write.parquet(str(tmp_path / "clean"))
    (r,) = totals_report(spark, totals).collect()
    assert (r.initial_records, r.invalid_times, r.duplicates, r.final_records, r.missing_records_filled) == (5, 1, 1, 3, 1)
    assert (r.start_date, r.end_date) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3)) and r.missing_pct == pytest.approx(100 / 3)
    assert "CollectMetrics" in plan
    want = clean_readings(raw, ["active_power_kw"])
    assert spark.read.parquet(str(tmp_path / "clean")).exceptAll(want).count() == 0
