"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import differences

# the corpus queries have tests of their own
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.CORPUS}
ROWS_ONLY = sorted(set(entry.queries()) - set(SQL) - set(entry.CORPUS))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, tables, small_dir):
    got = entry.queries()[name](spark, small_dir).toPandas()
    assert differences(got, tables.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(name, spark, small_dir):
    df = entry.queries()[name](spark, small_dir)
    assert df.count() > 0


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["meter_id", "day", "kwh", "previous_week_mean", "change_pct"]
    assert df.count() > 0


def test_only_models_lack_sql():
    assert set(ROWS_ONLY) == {
        "rf_forecast", "importances", "test_scores", "sequence_forecast",
    }
