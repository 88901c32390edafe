"""Raster scans and the conversion job on generated files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from inversia.operators.filters import point_columns
from inversia.plans import jobs
from inversia.plans.series import SeriesSpec
from inversia.sources import manifest, raster, sinks
from tests.test_operators import grid_of

HEADER = (
    "BYTEORDER {order}\nNROWS {rows}\nNCOLS {cols}\nNBANDS 1\nNBITS {bits}\nPIXELTYPE {kind}\n"
    "ULXMAP -85.0\nULYMAP 37.2\nXDIM 0.1\nYDIM 0.1\nNODATA -9999\n"
)
CELLS = np.array([[1, 2, 3, 4], [5, -9999, 7, 8], [9, 10, 11, 12]])
BOX = {"lon": (-84.95, -84.7), "lat": (36.95, 37.15)}


def put(folder, name, cells=CELLS, dtype="<f4", header=True, cut=0):
    data = cells.astype(dtype).tobytes()
    (folder / f"{name}.bil").write_bytes(data[: len(data) - cut])
    kind = {"f": "FLOAT", "i": "SIGNEDINT"}[np.dtype(dtype).kind]
    if header:
        text = HEADER.format(order="M" if dtype[0] == ">" else "I", rows=cells.shape[0], cols=cells.shape[1], bits=np.dtype(dtype).itemsize * 8, kind=kind)
        (folder / f"{name}.hdr").write_text(text)


def cells_of(df):
    return [(r.pixel, round(r.longitude, 6), round(r.latitude, 6), r.value) for r in df.orderBy("name", "pixel").collect()]


@pytest.mark.parametrize("dtype", ["<f4", ">i2", "<f8"])
def test_decode(spark, tmp_path, dtype):
    put(tmp_path, "grid_tmean_us_30s_20210102", dtype=dtype)
    df = raster.read_rasters(spark, str(tmp_path))
    got = cells_of(df)
    assert [c[3] for c in got] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
    assert got[0] == (0, -85.0, 37.2, 1) and got[-1] == (11, -84.7, 37.0, 12)
    row = df.select("timestamp", "variable").first()
    assert row.timestamp == dt.datetime(2021, 1, 2) and row.variable == "tmean"


def test_subsample_counts_cells_before_dropping_empty_ones(spark, tmp_path):
    put(tmp_path, "grid_tmean_us_30s_20210102")
    assert [c[0] for c in cells_of(raster.read_rasters(spark, str(tmp_path), every=5))] == [0, 10]


def test_region_window(spark, tmp_path):
    put(tmp_path, "grid_tmean_us_30s_20210102")
    got = cells_of(raster.read_rasters(spark, str(tmp_path), region=BOX))
    # rows 1..2 and columns 1..3; pixels are numbered within the window, the empty one is dropped
    assert [c[3] for c in got] == [7, 8, 10, 11, 12]
    assert [c[0] for c in got] == [1, 2, 3, 4, 5]
    assert got[0][1:3] == (-84.8, 37.1)
    assert [c[3] for c in cells_of(raster.read_rasters(spark, str(tmp_path), region=BOX, every=2))] == [8, 11]
    nowhere = {"lon": (10, 11), "lat": (10, 11)}
    assert raster.read_rasters(spark, str(tmp_path), region=nowhere).count() == 0


def test_blocks_do_not_matter(spark, tmp_path):
    put(tmp_path, "grid_tmean_us_30s_20210102", cells=np.arange(60).reshape(12, 5))
    files = raster.list_rasters(spark, str(tmp_path))
    whole = cells_of(raster.decode_rasters(files, BOX, 2))
    assert whole and whole == cells_of(raster.decode_rasters(files, BOX, 2, cells_per_block=10))


def test_normals_keep_empty_cells(spark, tmp_path):
    for month in ("01", "12"):
        put(tmp_path, f"normals_{month}")
    out = raster.read_monthly_normals(spark, str(tmp_path))
    assert out.count() == 24 and out.where(F.col("value").isNull()).count() == 2
    assert sorted({r.month for r in out.collect()}) == [1, 12]


def test_conversion_reports_bad_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "grid_tmean_us_30s_20210102")
    put(source, "grid_tmean_us_30s_20220102")
    put(source, "grid_tmean_us_30s_20210103", cut=4)
    put(source, "grid_tmean_us_30s_20210104", header=False)
    put(source, "notes")
    out = str(tmp_path / "out")
    found = jobs.convert_rasters(spark, str(source), grid_of(spark), out, variable="tmean", region=BOX)
    points = found["points"].where("year = 2021").orderBy("key").collect()
    assert [p.key for p in points] == [1, 2, 3, 4, 5]
    assert [p.altitude for p in points] == [130, 130, 120, 120, 120]
    assert {r.name for r in found["failures"].collect()} == {
        "grid_tmean_us_30s_20210103.bil", "grid_tmean_us_30s_20210104.bil", "notes.bil"
    }
    report = {r.year: (r.files, r.failed, r.points) for r in found["report"].collect()}
    assert report == {2021: (3, 2, 5), 2022: (1, 0, 5), None: (1, 1, 0)}
    back = spark.read.parquet(out)
    assert back.where("variable = 'tmean' and year = 2022").count() == 5
    only = jobs.convert_rasters(spark, str(source), None, years=[2022], region=BOX)["points"]
    assert only.count() == 5
    with pytest.raises(Exception):
        sinks.write_points(found["points"].drop("year"), out)


def test_listing_and_years(spark, tmp_path):
    for year in ("2020", "2021", "other"):
        folder = tmp_path / "tmean" / "daily" / year
        folder.mkdir(parents=True)
        put(folder, f"grid_tmean_us_30s_{year if year.isdigit() else '2022'}0101")
    files = manifest.list_files(spark, str(tmp_path), "*.bil")
    assert [r.year for r in manifest.years_of(files).collect()] == [2020, 2021]


def test_point_columns_order(spark):
    df = spark.createDataFrame(
        [("f", 5, 1.0, 2.0, 3.0, dt.datetime(2021, 1, 1)), ("f", 2, 1.5, 2.5, 3.5, dt.datetime(2021, 1, 1))],
        "name string, pixel bigint, longitude double, latitude double, tmean double, timestamp timestamp_ntz",
    )
    out = point_columns(df, SeriesSpec(("name",), "pixel"))
    assert out.columns == ["key", "altitude", "dist", "hr", "latitude", "longitude", "tmean", "timestamp"]
    assert [(r.key, r.tmean) for r in out.orderBy("key").collect()] == [(1, 3.5), (2, 3.0)]


def test_enrichment_writes_a_new_folder(spark, tmp_path):
    source, out = str(tmp_path / "points"), str(tmp_path / "enriched")
    df = spark.createDataFrame([(1, 37.04, -84.99)], "id int, latitude double, longitude double")
    sinks.write_table(df, source, "csv")
    jobs.enrich_points(spark, source, grid_of(spark), out)
    row = spark.read.option("header", True).csv(out).first()
    assert float(row.altitude) == 100 and spark.read.option("header", True).csv(source).columns == ["id", "latitude", "longitude"]
