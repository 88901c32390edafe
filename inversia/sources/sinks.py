"""Writers. Every result goes to a new path; nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_points(points: DataFrame, path: str, fmt: str = "parquet", ts: str = "timestamp") -> None:
    """``<path>/variable=<v>/year=<y>/``. The rebalance hint lets Spark merge small and split
    large output partitions at run time, so a year that holds most rows is written by many tasks."""
    dated = points.withColumn("year", F.year(ts))
    out = dated.hint("rebalance", "variable", "year").write.partitionBy("variable", "year")
    out.option("header", True).format(fmt).mode("errorifexists").save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.option("header", True).format(fmt).mode("errorifexists").save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Summary rows as JSON lines."""
    df.write.mode("errorifexists").json(path)


def save_model(model, path: str) -> None:
    """A fitted Spark model in its own folder; a stacked one as the folders of its parts."""
    parts = getattr(model, "bases", None)
    if parts is None:
        model.write().save(path)
        return
    for name, base in parts.items():
        base.write().save(f"{path}/{name}")
    model.top.write().save(f"{path}/top")
