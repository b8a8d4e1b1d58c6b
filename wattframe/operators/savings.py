"""Savings scenarios."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..schema import KWH, METER

DEFAULT_TARIFF = 0.18
DEFAULT_PCT = 15.0
DEFAULT_CO2 = 0.42
CO2_PER_TREE = 21.7


def savings(
    daily: DataFrame,
    scenarios: Iterable[tuple[float, float, float]] = ((DEFAULT_TARIFF, DEFAULT_PCT, DEFAULT_CO2),),
    key=[METER],
    y=KWH,
) -> DataFrame:
    """Yearly savings of every meter under every ``(tariff, pct, co2_factor)``.

    Meters are aggregated first; each mean is then repeated once per scenario, a
    list the caller wrote, so nothing is joined.
    """
    means = daily.groupBy(*key).agg(F.avg(y).alias("mean_kwh"))
    return means.transform(price, scenarios, key)


def price(means: DataFrame, scenarios, key=[METER]) -> DataFrame:
    listed = F.array(
        *[
            F.struct(*[F.lit(v).cast("double").alias(n) for n, v in zip(("tariff", "pct", "co2_factor"), scenario, strict=True)])
            for scenario in scenarios
        ]
    ).cast("array<struct<tariff:double,pct:double,co2_factor:double>>")
    d = means.withColumn("_s", F.explode(listed)).select(*key, "mean_kwh", "_s.*")
    annual = F.col("mean_kwh") * 365.0
    d = d.withColumn("annual_kwh", annual).withColumn("saved_kwh", F.col("annual_kwh") * (F.col("pct") / 100.0))
    d = d.withColumns(
        {"saved_money": F.col("saved_kwh") * F.col("tariff"), "saved_co2_kg": F.col("saved_kwh") * F.col("co2_factor")}
    )
    return d.withColumn("trees", F.floor(F.col("saved_co2_kg") / CO2_PER_TREE))


#: Rows that a scenario table may have.
MOST_SCENARIOS = 1_000


def savings_for(daily: DataFrame, scenarios: DataFrame, most: int = MOST_SCENARIOS, key=[METER], y=KWH) -> DataFrame:
    """``savings`` for the rows ``tariff, pct, co2_factor`` of a table of at most ``most`` rows.

    Each mean is repeated once per scenario, so a larger table is an error and not a
    result of that many times the meters. Equal scenarios count once; a scenario with a
    null gives null figures.
    """
    columns = ["tariff", "pct", "co2_factor"]
    rows = scenarios.select(*[F.col(c).cast("double") for c in columns]).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} scenarios")
    means = daily.groupBy(*key).agg(F.avg(y).alias("mean_kwh"))
    return means.transform(price, sorted(rows, key=str), key)
