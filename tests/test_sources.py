import datetime as dt

import pytest

from wattframe.operators.baselines import forecast_baseline
from wattframe.operators.outlook import finish_forecast
from wattframe.operators.reports import occupancy_box, temperature_effect
from wattframe.sources import (
    detect_layout, first_available, load_model, parse_lines, prepare_daily, read_profile, read_telemetry, resolve_target,
    write_forecast,
)
from wattframe.sources.layout import date_column, first_numeric_column, snake
from wattframe.sources.readers import guess_separator

HEADER = "Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3"


def weather_lines(days=60):
    start = dt.date(2025, 1, 1)
    out = ["Date,Day of Week,Temperature (C),Number of People at Home,Energy Consumption (kWh)"]
    for i in range(days):
        d = start + dt.timedelta(days=i)
        out.append(f"{d},{d:%A},{5 + i * 0.5},{1 + i % 3},{8 + i % 7}.25")
    return out


def test_weather_file(spark, tmp_path):
    lines = weather_lines()
    lines += [lines[3].replace(".25", ".75"), "not a day,Monday,1,1,1", "2025-03-09,Sunday,20,2,"]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    daily, report = prepare_daily(read_telemetry(spark, str(tmp_path / "w.csv")), target="Energy Consumption (kWh)")
    r = report.collect()[0]
    assert (r["dataset_type"], r["initial_records"], str(r["start_date"]), str(r["end_date"])) == ("daily", 63, "2025-01-01", "2025-03-09")
    rows = daily.orderBy("day").collect()
    assert rows[0]["kwh"] == 8.25 and rows[2]["kwh"] == 10.25 and rows[0]["day_name"] == rows[0]["src_day_of_week"]
    assert {"month", "src_temperature_c", "src_number_of_people_at_home"} <= set(daily.columns)
    typed = daily.selectExpr("meter_id", "day", "kwh", "double(src_temperature_c) AS temperature", "int(src_number_of_people_at_home) AS people")
    assert sum(x["n"] for x in occupancy_box(typed).collect()) == len(rows)


@pytest.mark.parametrize("spine", [False, True])
def test_plain_dataframe(spark, spine):
    raw = spark.createDataFrame([("2025-01-01", 3.0), ("2025-01-02", 4.0), ("2025-01-02", 9.0), ("2025-01-05", 5.0)], "date STRING, kwh DOUBLE").coalesce(1)
    daily, _ = prepare_daily(raw, target="kwh", spine=spine)
    rows = daily.orderBy("day").collect()
    assert len(rows) == (5 if spine else 3) and rows[1]["kwh"] == 4.0


def test_place_is_unique_over_many_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.csv").write_text(f"date,kwh\n2025-01-01,{i}\n2025-01-02,{i}\n")
    raw = read_telemetry(spark, str(tmp_path))
    assert raw.select("seq").distinct().count() == raw.count() == 600
    first = lambda: {(str(r["day"]), r["kwh"]) for r in prepare_daily(read_telemetry(spark, str(tmp_path)), target="kwh")[0].collect()}
    assert first() == first()


def test_minute_file(spark, tmp_path):
    lines = [HEADER]
    t = dt.datetime(2006, 12, 16, 23, 0)
    for i in range(120):
        kw = "?" if i % 10 == 3 else f"{1 + i % 5}.0"
        lines.append(f"{t.day}/{t.month}/{t.year};{t:%H:%M:%S};{kw};0.1;240.0;4.0;0.0;1.0;2.0")
        t += dt.timedelta(minutes=1)
    lines += [lines[5].replace(";4.0;0.0", ";9.0;0.0"), "31/02/2007;00:00:00;1;1;1;1;1;1;1"]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    raw = read_telemetry(spark, str(tmp_path / "m.txt"))
    assert detect_layout(raw.columns) == "minute"
    daily, report = prepare_daily(raw)
    r = report.collect()[0]
    assert (r["initial_records"], r["invalid_times"], r["duplicates"], r["final_records"], r["missing_records_filled"]) == (122, 1, 1, 120, 12)
    rows = daily.orderBy("day").collect()
    assert [str(x["day"]) for x in rows] == ["2006-12-16", "2006-12-17"]
    assert all(x["intensity_mean"] == 4.0 for x in rows) and rows[0]["sub3_wh"] == 120.0
    assert rows[0]["kwh"] == pytest.approx(rows[0]["power_sum"] / 60)


def test_file_order_over_several_splits(spark, tmp_path):
    body = "\n".join(f"{i},{'x' * 40}" for i in range(20000))
    (tmp_path / "long.csv").write_text("n,t\n" + body + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_telemetry(spark, str(tmp_path / "long.csv"))
        assert df.rdd.getNumPartitions() > 5
        rows = df.selectExpr("int(n) AS n", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["n"] for r in sorted(rows, key=lambda r: r["seq"])] == list(range(20000))


def test_markers_and_lines(spark):
    lines = spark.createDataFrame([("a;?;NA",), ("null;N/A;1",), ("None;;nan",)], "line STRING")
    got = parse_lines(lines, ["x", "y", "z"]).collect()
    assert [tuple(r) for r in got] == [("a", None, None), (None, None, "1"), (None, None, None)]
    assert guess_separator("a;b,c") == ";" and guess_separator("a,b") == ","


def test_three_row_table_in_memory(spark):
    df = spark.createDataFrame(
        [("2026-01-01", 25.4, 18.5, 0), ("2026-01-02", 28.1, 19.2, 1), ("2026-01-03", 31.0, 22.0, 2)],
        "Date STRING, Daily_energy_kWh DOUBLE, Temperature DOUBLE, seq BIGINT",
    )
    daily, _ = prepare_daily(read_telemetry(spark, df))
    assert [r["kwh"] for r in daily.orderBy("day").collect()] == [25.4, 28.1, 31.0]


def test_first_of_a_plain_table_whatever_its_partitions(spark):
    rows = [("2024-01-%02d" % (d % 20 + 1), "v%d" % (d // 20 % 3), float(d)) for d in range(200)]
    df = spark.createDataFrame(rows, "date STRING, version STRING, kwh DOUBLE")
    got = []
    for parts in (df.coalesce(1), df.repartition(7), df.orderBy(df["kwh"].desc())):
        daily, _ = prepare_daily(parts, target="kwh", order=["version"])
        got.append(sorted((str(r["day"]), r["src_version"], r["kwh"]) for r in daily.collect()))
    assert got[0] == got[1] == got[2]
    assert [x[1] for x in got[0]] == ["v0"] * 20


def test_daily_rows_are_not_resampled_unless_asked(spark):
    df = spark.createDataFrame([("2026-01-01", 1.0, 0), ("2026-01-04", 4.0, 1)], "Date STRING, Daily_energy_kWh DOUBLE, seq BIGINT")
    assert prepare_daily(df)[0].count() == 2
    assert [r["kwh"] for r in prepare_daily(df, spine=True)[0].orderBy("day").collect()] == [1.0, 0.0, 0.0, 4.0]


def test_target_and_date_choice(spark):
    df = spark.createDataFrame([("2026-01-01", "x", "1.5")], "When STRING, label STRING, v STRING")
    assert first_numeric_column(df) == "v" and resolve_target(df) == "v" and date_column(df.columns) == "When"
    assert date_column(["a", "Update time"]) == "Update time"
    assert resolve_target(df.withColumnRenamed("label", "Power (kW)")) == "Power (kW)"
    assert snake("Temperature (°C)") == "temperature_c"


def test_fallback_order(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b.parquet"))
    (tmp_path / "c.csv").write_text("Date,v\n2026-01-01,1\n")
    name, df = first_available(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet"), str(tmp_path / "c.csv")])
    assert name.endswith("b.parquet") and df.count() == 3
    assert first_available(spark, ["no_such_table", str(tmp_path / "c.csv")])[0].endswith("c.csv")
    with pytest.raises(FileNotFoundError):
        first_available(spark, [str(tmp_path / "zzz.parquet")])


def test_forecast_export(spark, series, tmp_path):
    fc = finish_forecast(forecast_baseline(series({"a": [1, 2]}), "ma", 7))
    write_forecast(fc, str(tmp_path / "fc"))
    back = spark.read.csv(str(tmp_path / "fc"), header=True)
    assert back.count() == 7 and "model" in back.columns
    assert sum(p.stat().st_size for p in (tmp_path / "fc").rglob("*.csv")) > 100


def test_missing_profile_and_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_profile(spark, str(tmp_path / "none"))
    assert load_model(spark, str(tmp_path / "none")) is None
