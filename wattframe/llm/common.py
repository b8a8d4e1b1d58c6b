"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Runs of non-white-space as an array; empty for a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that later expressions read as a stored value.

    Lambdas evaluate the expressions they refer to for each element; a generator
    over one element keeps the optimiser from pasting ``value`` into them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null gives empty bytes."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into dicts of columns, in the order of ``schema``."""
    arrow = arrow_schema(df, schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
