"""Turn raw station exports (all text) into typed columns; NaN never survives ingest."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The timestamp formats tried after the ISO form, in this order.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
)


def number(col: Column) -> Column:
    """Text or number to double; what is not a number, NaN included, becomes null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(col: Column) -> Column:
    """Null for NaN and both infinities (Spark orders NaN above infinity)."""
    return F.when(F.abs(col) < F.lit(float("inf")), col)


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The given columns that the table has; operators skip absent ones."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Force columns to double, bad values to null (one projection)."""
    wanted = existing(df, columns)
    return df.withColumns({c: number(F.col(c)) for c in wanted}) if wanted else df


def parse_time(col: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First format that reads the text, else null."""
    tries = [F.try_to_timestamp(col), *[F.try_to_timestamp(col, F.lit(f)) for f in formats]]
    return F.coalesce(*tries)


def with_parsed_time(df: DataFrame, ts: str, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Typed time column; rows whose time cannot be read are dropped (units rows, repeated headers)."""
    if isinstance(df.schema[ts].dataType, T.StringType):
        df = df.withColumn(ts, parse_time(F.col(ts), formats))
    return df.where(F.col(ts).isNotNull())
