"""Flat binary grids: a band of numbers (``.bil``) with a text header (``.hdr``) beside it.

The table of files holds names and headers only. Each file becomes a few *blocks* of raster rows;
a block is one small record, and the task that gets it reads just its byte range, cut to the
region's rows. One large file is so read by many tasks; blocks without a row of the region are no
tasks, and of the rows read only the region's columns are kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inversia.sources.manifest import file_name, list_files, name_parts

CELLS_PER_BLOCK = 1 << 18
MAX_BLOCK_TASKS = 20_000
# Header words and their defaults.
HEADER = {
    "NROWS": None,
    "NCOLS": None,
    "NBITS": "32",
    "PIXELTYPE": "FLOAT",
    "BYTEORDER": "I",
    "ULXMAP": None,
    "ULYMAP": None,
    "XDIM": None,
    "YDIM": None,
    "NODATA": "-9999",
}
CELL_SCHEMA = (
    "name string, variable string, date date, pixel bigint, longitude double, latitude double, value float, error string"
)


def _header_word(text: Column, word: str, default: str | None) -> Column:
    found = F.regexp_extract(text, rf"(?im)^\s*{word}\s+(\S+)", 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per header file: stem of its path and the header words."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.hdr")
        .text(path, wholetext=True)
        .select(F.col("value").alias("_text"), F.col("_metadata.file_path").alias("_path"))
    )
    words = {
        w: _header_word(F.col("_text"), w, d) for w, d in HEADER.items()
    }
    numbers = ("NROWS", "NCOLS", "NBITS")
    reals = ("ULXMAP", "ULYMAP", "XDIM", "YDIM", "NODATA")
    typed = {
        w.lower(): c.try_cast("bigint") if w in numbers else c.try_cast("double") if w in reals else F.upper(c)
        for w, c in words.items()
    }
    return files.select(_stem(F.col("_path")).alias("stem"), *[c.alias(n) for n, c in typed.items()])


def _stem(path: Column) -> Column:
    """Path without scheme and ending, so that both readers' spellings of a path agree."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), r"\.[^./]+$", "")


def list_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Grid files with name metadata and header; ``error`` says why one cannot be read."""
    bands = list_files(spark, path, "*.bil").withColumn("stem", _stem(F.col("path")))
    joined = bands.join(read_headers(spark, path), "stem", "left")
    parts = name_parts(F.col("name"))
    need = F.col("nrows") * F.col("ncols") * F.col("nbits") / 8
    complete = F.col("xdim").isNotNull() & F.col("ydim").isNotNull() & F.col("ulxmap").isNotNull() & F.col("ulymap").isNotNull()
    error = (
        F.when(F.col("date").isNull(), "file name does not match the expected pattern")
        .when(need.isNull() | ~complete, "header missing or incomplete")
        .when(F.col("length") < need, "file is shorter than its header says")
    )
    return joined.withColumns(parts).withColumn("error", error)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path that the workers reach, and its path there."""
    if path.startswith("file:"):
        path = "file:///" + path[len("file:") :].lstrip("/")
    elif path.startswith("s3a:"):
        path = "s3:" + path[len("s3a:") :]
    return pafs.FileSystem.from_uri(path)


def _open(path: str):
    """Input file of any filesystem the workers reach."""
    filesystem, inner = _store(path)
    return filesystem.open_input_file(inner)


def open_stream(path: str):
    """The bytes of a file from its start on, unpacked if its name says that it is packed."""
    filesystem, inner = _store(path)
    return filesystem.open_input_stream(inner, compression="detect")


def _span(start: float, stop: float, n: int) -> tuple[int, int]:
    """First index and one past the last of the cell centres 0..n-1 within [start, stop]."""
    tolerance = 1e-9
    return max(0, int(np.ceil(start - tolerance))), min(n, int(np.floor(stop + tolerance)) + 1)


def _decode(block: dict, region: dict | None, every: int, keep_nodata: bool) -> dict[str, np.ndarray]:
    """The wanted cells of one block of raster rows."""
    kind = {"FLOAT": "f", "SIGNEDINT": "i", "UNSIGNEDINT": "u"}[block["pixeltype"] or "FLOAT"]
    order = ">" if block["byteorder"] in ("M", "MSBFIRST") else "<"
    dtype = np.dtype(f"{order}{kind}{block['nbits'] // 8}")
    rows, cols = block["nrows"], block["ncols"]
    row0, row1, col0, col1 = 0, rows, 0, cols
    if region:
        (west, east), (south, north) = region["lon"], region["lat"]
        col0, col1 = _span((west - block["ulxmap"]) / block["xdim"], (east - block["ulxmap"]) / block["xdim"], cols)
        row0, row1 = _span((block["ulymap"] - north) / block["ydim"], (block["ulymap"] - south) / block["ydim"], rows)
    first, last = max(row0, block["first_row"]), min(row1, block["first_row"] + block["n_rows"])
    width = col1 - col0
    if last <= first or width <= 0:
        return {"pixel": np.empty(0, np.int64), "lon": np.empty(0), "lat": np.empty(0), "value": np.ma.empty(0, np.float32)}
    with _open(block["path"]) as f:
        f.seek(first * cols * dtype.itemsize)
        raw = f.read((last - first) * cols * dtype.itemsize)
    band = np.frombuffer(raw, dtype=dtype).reshape(last - first, cols)[:, col0:col1].astype(np.float32)
    # subsampling counts the cells of the window row by row, before empty cells are dropped
    pixel = np.arange((first - row0) * width, (last - row0) * width, dtype=np.int64)
    value = band.reshape(-1)
    empty = (value == np.float32(block["nodata"])) | np.isnan(value)
    keep = pixel % every == 0
    if not keep_nodata:
        keep &= ~empty
    pixel, value, empty = pixel[keep], value[keep], empty[keep]
    return {
        "pixel": pixel,
        "lon": block["ulxmap"] + (col0 + pixel % width) * block["xdim"],
        "lat": block["ulymap"] - (row0 + pixel // width) * block["ydim"],
        "value": np.ma.masked_array(value, mask=empty),
    }


def _reader(region: dict | None, every: int, keep_nodata: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                error, cells = block["error"], None
                if error is None:
                    try:
                        cells = _decode(block, region, every, keep_nodata)
                    except Exception as problem:  # a bad file is reported, the others go on
                        error = f"{type(problem).__name__}: {problem}"
                if cells is None:
                    columns = [pa.nulls(1, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float32())]
                else:
                    value = cells["value"]
                    columns = [
                        pa.array(cells["pixel"]),
                        pa.array(cells["lon"], pa.float64()),
                        pa.array(cells["lat"], pa.float64()),
                        pa.array(value.data, pa.float32(), mask=np.ma.getmaskarray(value)),
                    ]
                n = len(columns[0])
                fixed = [
                    pa.array([block[c]] * n, t)
                    for c, t in (("name", pa.string()), ("variable", pa.string()), ("date", pa.date32()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*fixed, *columns, pa.array([error] * n, pa.string())],
                    names=["name", "variable", "date", "pixel", "longitude", "latitude", "value", "error"],
                )

    return read


def decode_rasters(
    files: DataFrame,
    region: dict | None = None,
    every: int = 1,
    keep_nodata: bool = False,
    cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """Cells of a ``list_rasters`` table with their file's metadata; unreadable files give one row
    with ``error`` set."""
    per_block = F.greatest(F.lit(1), F.floor(F.lit(cells_per_block) / F.col("ncols"))).cast("bigint")
    starts = F.when(F.col("error").isNull(), F.sequence(F.lit(0).cast("bigint"), F.col("nrows") - 1, per_block)).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    blocks = files.select("*", per_block.alias("n_rows"), F.explode(starts).alias("first_row")).select(
        "path", "name", "variable", "date", "first_row", "n_rows", "nrows", "ncols", "nbits", "pixeltype", "byteorder",
        "ulxmap", "ulymap", "xdim", "ydim", "nodata", "error",
    )
    if region:
        # blocks without a row whose centre lies in the region are not read; errors stay
        south, north = region["lat"]
        top = F.col("ulymap") - F.col("first_row") * F.col("ydim")
        bottom = F.col("ulymap") - (F.least(F.col("first_row") + F.col("n_rows"), F.col("nrows")) - 1) * F.col("ydim")
        slack = F.col("ydim") * 1e-6
        inside = (top >= F.lit(south) - slack) & (bottom <= F.lit(north) + slack)
        blocks = blocks.where(F.col("error").isNotNull() | inside)
    # block records are tiny, so their number and not their size must set the parallelism
    tasks = max(1, min(MAX_BLOCK_TASKS, blocks.count()))
    cells = blocks.repartition(tasks).mapInArrow(_reader(region, every, keep_nodata), CELL_SCHEMA)
    return cells.select(
        "name",
        "variable",
        "pixel",
        "longitude",
        "latitude",
        "value",
        F.col("date").cast("timestamp_ntz").alias("timestamp"),
        "error",
    )


def read_rasters(
    spark: SparkSession, path: str, region: dict | None = None, every: int = 1, keep_nodata: bool = False
) -> DataFrame:
    """Good cells of every grid file below a folder."""
    cells = decode_rasters(list_rasters(spark, path), region, every, keep_nodata)
    return cells.where(F.col("error").isNull()).drop("error")


def read_monthly_normals(spark: SparkSession, path: str, pattern: str = r"(\d{2})\.bil$") -> DataFrame:
    """Normals, one file per month of the year; empty cells are kept as null."""
    files = list_rasters(spark, path)
    month = F.regexp_extract(file_name(F.col("path")), pattern, 1)
    # normals are named by month, not by day
    readable = F.when(F.col("nrows").isNull(), "header missing or incomplete")
    chosen = files.where(month != "").withColumns({"error": readable, "variable": F.lit("normal")})
    cells = decode_rasters(chosen, keep_nodata=True).where(F.col("error").isNull())
    return cells.select(
        F.regexp_extract("name", pattern, 1).cast("int").alias("month"), "pixel", "longitude", "latitude", "value"
    )
