"""Registry of runnable queries and the SQL that checks them.

A query gives a DataFrame; ``spec`` says how its columns are shown (dates as
text, whole numbers as BIGINT, doubles rounded), on both sides alike::

    meter_id        as it is        day:d     date as yyyy-MM-dd
    days:i          BIGINT          ts:t      yyyy-MM-dd HH:mm:ss
    kwh:6           rounded to 6 places
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _parts(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.replace(",", " ").split():
        name, _, kind = item.partition(":")
        out.append((name, kind))
    return out


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "":
        return c
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    # adding 0.0 turns a negative zero into a plain one
    return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "":
        return name
    if kind == "d":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}"


def show(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_spark_column(n, k) for n, k in _parts(spec)])


def show_sql(body: str, spec: str) -> str:
    cols = ", ".join(_sql_column(n, k) for n, k in _parts(spec))
    return f"SELECT {cols} FROM (\n{body.strip()}\n) AS q"


def query(spec: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return show(fn(spark, sf_dir), spec)

        ENTRIES[name or fn.__name__] = Entry(run, show_sql(sql, spec) if sql else None)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
