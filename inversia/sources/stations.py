"""Station table scans: raw text exports and parquet, one or many sites."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inversia.functions.coercion import coerce_numeric, finite, with_parsed_time
from inversia.operators.impute import SENSORS
from inversia.sources.raster import open_stream

#: Bytes of a file read for its header, files read at once, stores that pyarrow opens.
HEAD_BYTES, MOST_TASKS, STORES = 1 << 16, 1_000, ("file", "hdfs", "s3", "s3a", "gs", "abfs")
SITE, COUNTY, TIME = "NetSiteAbbrev", "County", "UTCTimestampCollected"


def union_sites(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a site lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file, of which no more is read than that needs."""
    for batch in batches:
        heads = []
        for path in batch.column(0).to_pylist():
            with open_stream(path) as f:
                line = f.read(HEAD_BYTES)
                while not (ends := re.search(rb"[\r\n]", line)) and (more := f.read(HEAD_BYTES)):
                    line += more
            heads.append(line[: ends.start() if ends else None].decode("utf-8", "replace").removeprefix("\ufeff"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.string())], ["file_path", "header"])


def _headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file_path`` and ``header`` of every file: its first bytes, read where pyarrow knows the
    store, else its lines as Spark reads them."""
    files = spark.read.format("binaryFile").load(list(paths)).where("length > 0").select(F.col("path").alias("file_path"))  # a listing
    first = files.first()
    if first is None or re.match(rf"({'|'.join(STORES)}):", first["file_path"]):
        return files.repartition(max(1, min(MOST_TASKS, files.count()))).mapInArrow(_first_lines, "file_path string, header string")
    lines = spark.read.text(list(paths)).select("value", "_metadata.file_path", "_metadata.file_block_start")
    numbered = lines.where("file_block_start = 0").withColumn("_at", F.monotonically_increasing_id())
    return numbered.groupBy("file_path").agg(F.min_by("value", "_at").alias("header"))


def header_groups(spark: SparkSession, *paths: str) -> list[list[str]]:
    """The files under the paths, those with the same header line together; empty files are left out.

    Only first lines reach the driver, one for each file, as a listing of the files would."""
    groups: dict[str, list[str]] = {}
    for row in _headers(spark, paths).orderBy("file_path").collect():
        groups.setdefault(row["header"], []).append(row["file_path"])
    return list(groups.values())


def read_raw_stations(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw exports as text columns named by each file's own header; types are never inferred.

    Exports of different sites order and name their columns differently, also within a folder, so
    files are read in groups of equal headers and stacked by name."""
    groups = header_groups(spark, *paths)
    if not groups:
        return spark.read.option("header", True).option("inferSchema", False).csv(list(paths))
    return union_sites(*[spark.read.option("header", True).option("inferSchema", False).csv(files) for files in groups])


def type_stations(raw: DataFrame, ids: Sequence[str] = (SITE, COUNTY), ts: str = TIME) -> DataFrame:
    """Text export to typed station table: parsed times, numbers or null, no units rows, no
    unnamed index columns. Ids stay text."""
    index = [c for c in raw.columns if c.startswith("Unnamed") or c == "_c0"]
    typed = with_parsed_time(raw.drop(*index), ts)
    sensors = [
        f.name
        for f in typed.schema.fields
        if f.name not in {*ids, ts} and (isinstance(f.dataType, T.StringType) or f.name in SENSORS)
    ]
    return coerce_numeric(typed, sensors)


def read_stations(spark: SparkSession, *paths: str, ts: str = TIME) -> DataFrame:
    """Typed station table from CSV exports or parquet (by ending)."""
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        table = union_sites(*[spark.read.parquet(p) for p in paths])
        real = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        return table.withColumns({c: finite(F.col(c)) for c in real}) if real else table
    return type_stations(read_raw_stations(spark, *paths), ts=ts)


def preview(df: DataFrame, order: Sequence[str], rows: int = 10) -> DataFrame:
    """First rows in a stated order (a distributed top-n)."""
    return df.orderBy(*order).limit(rows)
