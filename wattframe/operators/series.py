"""Long series without long tasks.

A window partitioned by meter keeps a meter's whole series in one task. That is
fine after the daily roll-up, where a calendar bounds the series, and not fine
for raw readings, where one meter may own a third of the table. The helpers here
cut a series in blocks, exactly: positions are global, and every block brings
the few earlier rows its look-back needs.

Rows without a key or a time are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = "_block"
CHUNK = "_chunk"
HALO = "_halo"


def block_of(time: str, unit: str) -> Column:
    return F.to_date(time) if unit == "day" else F.date_trunc(unit, time)


def with_position(
    df: DataFrame, key: list[str], time: str, block: Column | None = None, name: str = "_pos"
) -> DataFrame:
    """Add the 1-based row number of each row in its series.

    Rows are numbered inside ``(key, block)`` groups; the rows before each block
    come from the table of block counts, which is small. ``block`` must not
    decrease with ``time`` (default: the day of ``time``).
    """
    d = df.withColumn(BLOCK, block if block is not None else F.to_date(time))
    d = d.where(F.col(BLOCK).isNotNull())  # stated here, both sides of the join share one shuffle
    for k in key:
        d = d.where(F.col(k).isNotNull())
    before = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*key, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*key, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*key, BLOCK).orderBy(time)
    return (
        d.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*key, BLOCK])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop(BLOCK, "_inside", "_before")
    )


def in_chunks(
    df: DataFrame,
    key: list[str],
    time: str,
    lookback: int,
    fn: Callable[[DataFrame, list[str]], DataFrame],
    chunk_rows: int = 50_000,
    unit: str = "hour",
) -> DataFrame:
    """Run a backward-looking window function on chunks of at most
    ``chunk_rows + lookback`` rows; the result equals that on the whole series.

    ``fn(df, key)`` gets the chunked frame and the extended key, and may add
    columns that depend on the row itself and up to ``lookback`` earlier rows.
    Rows are numbered in blocks of one time ``unit``; pass a finer one for readings
    many times a second.
    """
    if not 0 < lookback < chunk_rows:
        raise ValueError("need 0 < lookback < chunk_rows")
    pos = with_position(df, key, time, block_of(time, unit))
    zero = F.col("_pos") - 1
    own = F.floor(zero / chunk_rows)
    rest = F.pmod(zero, F.lit(chunk_rows))
    here = F.struct(own.alias("c"), F.lit(False).alias("h"))
    also = F.struct((own + 1).alias("c"), F.lit(True).alias("h"))
    copies = F.when(rest >= chunk_rows - lookback, F.array(here, also)).otherwise(F.array(here))
    spread = (
        pos.withColumn("_copy", F.explode(copies))
        .withColumn(CHUNK, F.col("_copy.c"))
        .withColumn(HALO, F.col("_copy.h"))
        .drop("_copy", "_pos")
    )
    return fn(spread, [*key, CHUNK]).where(~F.col(HALO)).drop(CHUNK, HALO)


def last_rows(df: DataFrame, key: list[str], time: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series (pre-filtered before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.col(time).desc())
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")
