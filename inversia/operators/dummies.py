"""Dummy columns for text values, by a vocabulary that is counted once and applied to any table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OTHER = "other"


def vocabulary(df: DataFrame, columns: Sequence[str], width: int = 50) -> DataFrame:
    """``column``, ``value``, ``place``, ``n``: the ``width`` most frequent values of each column (of
    equals the first by name), and one row with a null value for all others together, if there are any.

    Null cells are no value. Counts are combined before the shuffle, and of a column's values only
    the most frequent ones of each task are compared."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    kept = counts.withColumn("place", place).where(F.col("place") <= width).select("column", "value", "place", "n")
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rest = kept.groupBy("column").agg(F.sum("n").alias("known")).join(totals, "column").where("total > known")
    others = rest.select("column", F.lit(None).cast("string").alias("value"), F.lit(width + 1).alias("place"), (F.col("total") - F.col("known")).alias("n"))
    return kept.unionByName(others)


def column_name(column: str, value: str | None) -> str:
    """The dummy's column: the value's letters, digits, ``_``, ``-`` and ``.``, others as ``_``."""
    return f"{column}_{OTHER}" if value is None else f"{column}_{re.sub(r'[^\w.-]', '_', value)}"


def add_dummies(df: DataFrame, words: DataFrame) -> DataFrame:
    """One 0/1 column for each value of the vocabulary and one for every other value, in the
    vocabulary's order; values it doesn't know, seen first in this table, are others. Null cells are 0
    in all. Columns of the vocabulary that the table lacks are skipped. Values whose names become
    equal are told apart by their place; columns of the same names are replaced."""
    rows = words.orderBy("column", "place").collect()  # width + 1 rows a column
    made: dict[str, F.Column] = {}
    for column in dict.fromkeys(r["column"] for r in rows):
        if column not in df.columns:
            continue
        values = [(r["value"], r["place"]) for r in rows if r["column"] == column and r["value"] is not None]
        text = F.col(column).cast("string")
        for value, place in values:
            name = column_name(column, value)
            made[name if name not in made else f"{name}_{place}"] = F.coalesce(text == F.lit(value), F.lit(False)).cast("int")
        unknown = text.isNotNull() & ~text.isin([v for v, _ in values]) if values else text.isNotNull()
        made[column_name(column, None)] = unknown.cast("int")
    return df.withColumns(made) if made else df
