"""Reading telemetry files, lines and tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import NULL_MARKERS, SEQ


def _null_markers(c: str) -> Column:
    quoted = F.col(f"`{c}`")
    return F.when(~F.trim(quoted).isin(NULL_MARKERS), quoted).alias(c)


def blank_markers(df: DataFrame) -> DataFrame:
    """Null wherever a text cell holds one of the no-value markers."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[_null_markers(c) if c in text else F.col(f"`{c}`") for c in df.columns])


def guess_separator(first_line: str) -> str:
    return ";" if ";" in first_line else ","


def read_telemetry(
    spark: SparkSession, source: str | list[str] | DataFrame, sep: str | None = None, seq: str | None = SEQ
) -> DataFrame:
    """Delimited text with a header, as text columns with markers nulled.

    A DataFrame passes through unchanged. Types are not inferred: that would be
    a second pass over the data, and the cleaning step converts explicitly.

    ``seq`` is the place of a row: a hash of the file, then byte offset of the
    split plus row number in the task. It increases along each file, which is what
    "keep the first of the copies" needs, and it is the same in every run over
    the same files.
    """
    if isinstance(source, DataFrame):
        return source
    if sep is None:
        first = spark.read.text(source).limit(1).head()
        sep = guess_separator(first[0] if first else "")
    raw = spark.read.csv(source, header=True, sep=sep, inferSchema=False, enforceSchema=False)
    if seq is None:
        return blank_markers(raw)
    file_no = F.xxhash64("_metadata.file_path").alias("file")
    row_no = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.struct(file_no, (F.col("_metadata.file_block_start") + row_no).alias("place"))
    placed = raw.select(*[F.col(f"`{c}`") for c in raw.columns], place.alias(seq))
    return blank_markers(placed)


def parse_lines(lines: DataFrame, columns: list[str], sep: str = ";", text: str = "line") -> DataFrame:
    """Columns from a table of text lines (no header), markers nulled; the other
    columns of ``lines`` are kept."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    rest = [c for c in lines.columns if c != text]
    # an empty line gives a null struct, hence one row of nulls
    parsed = lines.select(*rest, F.from_csv(F.col(text), schema, {"sep": sep}).alias("_r"))
    flat = parsed.select(*rest, *[F.col(f"_r.`{c}`").alias(c) for c in columns])
    return flat.select(*rest, *[_null_markers(c) for c in columns])


def first_available(spark: SparkSession, candidates: Iterable[str], **options) -> tuple[str, DataFrame]:
    """The first candidate that exists: a catalogue table, a Parquet folder
    (``.parquet``) or delimited text. Put the roll-up before the raw files."""
    tried = []
    for c in candidates:
        try:
            if "/" not in c and spark.catalog.tableExists(c):
                return c, spark.table(c)
            if c.rstrip("/").endswith(".parquet"):
                return c, spark.read.parquet(c)
            if "/" in c or c.endswith((".csv", ".txt")):
                return c, read_telemetry(spark, c, **options)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        tried.append(c)
    raise FileNotFoundError(f"none of these exists: {tried}")
