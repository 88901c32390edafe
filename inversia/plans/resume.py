"""Conversion of grid files that can be broken off and gone on with.

Each run writes the points of its files into a folder of its own and then, as its last act, one small
table that names them: path, size and time of each file. Only what such a table names counts. A run
that breaks leaves a folder that nothing names; the next run converts those files again. A file that
has changed since is converted again, and its newer entry replaces the older one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inversia.operators import filters, spatial
from inversia.operators.nearest import nearest_known_cell
from inversia.plans.joins import match
from inversia.plans.jobs import run_report, wanted_files
from inversia.plans.series import SeriesSpec
from inversia.session import staged
from inversia.sources import raster
from inversia.sources.manifest import file_name

MANIFEST, POINTS = "manifest", "points"
ENTRY = "run string, path string, length bigint, modified timestamp, name string, variable string, year int, points bigint"
IDENTITY = ("path", "length", "modified")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The newest entry of every file path that a finished run converted."""
    path = f"{out}/{MANIFEST}"
    if not _exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(path)
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("run")))  # a file's runs
    return entries.withColumn("_n", newest).where("_n = 1").drop("_n")


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``modified`` of every grid file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bil").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def pending(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The files that no finished run has converted as they are now."""
    return file_states(spark, path).join(committed(spark, out).select(*IDENTITY), list(IDENTITY), "left_anti")


def read_points(spark: SparkSession, out: str) -> DataFrame:
    """The points of all files that count, with ``variable``, ``year`` and ``file`` (its path)."""
    done = committed(spark, out).where("points > 0").select("run", F.col("path").alias("file"))
    if not _exists(spark, f"{out}/{POINTS}"):
        raise FileNotFoundError(f"no converted points below {out}")
    points = spark.read.option("basePath", f"{out}/{POINTS}").parquet(f"{out}/{POINTS}")
    return points.join(done, ["run", "file"], "left_semi").drop("run")


def convert_new_rasters(
    spark: SparkSession,
    path: str,
    out: str,
    grid: DataFrame | None = None,
    variable: str | None = None,
    years: Sequence[int] | None = None,
    pattern: str | None = None,
    region: dict | None = filters.REGION,
    every: int = 1,
    fill_holes: bool = False,
) -> dict[str, DataFrame]:
    """Convert what is new below ``path`` into ``out`` (``points/run=/variable=/year=``).

    ``converted``: the files of this run; ``failures``: files that cannot be read, which stay pending;
    ``report`` per year. A file without a cell in the region counts as converted. ``fill_holes`` gives
    points over absent or empty terrain cells the nearest known altitude. One run at a time: of two
    at once both would convert the same files, and the later entry would count."""
    todo = staged(pending(spark, path, out), "pending")
    files = raster.list_rasters(spark, path).join(todo.select("path", "modified"), "path").withColumn("year", F.year("date"))
    if variable is not None:
        files = files.where(F.coalesce(F.col("variable") == variable, F.lit(True)))
    files = staged(wanted_files(files, years, pattern), "files")
    cells = staged(_with_paths(files, region, every), "cells")
    good = cells.where(F.col("error").isNull()).drop("error")
    if grid is not None:
        places = good.select("longitude", "latitude").distinct()
        altitude = nearest_known_cell(places, grid) if fill_holes else spatial.add_altitude(places, grid)
        good = good.join(altitude.select("longitude", "latitude", "altitude"), ["longitude", "latitude"], "left")
    # a run's name sorts after those before it; what a broken run left behind has another name
    last = committed(spark, out).agg(F.max("run")).first()[0]
    number = int(re.match(r"\d+", last).group()) + 1 if last else 1
    run = f"{number:08d}-{uuid.uuid4().hex}"
    # the file's path goes on as a value of its points
    points = filters.point_columns(good.withColumn("file_path", F.col("file")), SeriesSpec(("name", "file"), "pixel")).withColumnRenamed("file_path", "file")
    points = points.withColumn("year", F.year("timestamp"))
    dated = points.hint("rebalance", "variable", "year").write.partitionBy("variable", "year")
    dated.mode("errorifexists").parquet(f"{out}/{POINTS}/run={run}")
    counts = cells.groupBy(F.col("file").alias("path")).agg(F.count(F.when(F.col("error").isNull(), 1)).alias("points"), F.max("error").alias("error"))
    # the decoder passes on what the listing found wrong
    known = match(files.drop("error"), staged(counts, "counts"), ["path"], "left")
    entries = known.where(F.col("error").isNull()).select(
        F.lit(run).alias("run"), "path", "length", "modified", "name", "variable", "year", F.coalesce("points", F.lit(0)).alias("points")
    )
    entries = staged(entries, "entries")
    entries.coalesce(1).write.mode("errorifexists").parquet(f"{out}/{MANIFEST}/{run}")  # a row per file
    failures = known.where(F.col("error").isNotNull()).select("name", "error")
    return {"converted": entries, "failures": failures, "report": run_report(files, cells)}


def _with_paths(files: DataFrame, region: dict | None, every: int) -> DataFrame:
    """Decoded cells with ``file``, the path they come from; ``name`` is the file's name again."""
    tagged = files.withColumn("name", F.col("path"))
    cells = raster.decode_rasters(tagged, region, every)
    return cells.withColumn("file", F.col("name")).withColumn("name", file_name(F.col("file")))
