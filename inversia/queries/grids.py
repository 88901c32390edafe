"""Queries on rasters, the terrain join and point fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from inversia.operators import density, nearest, spatial
from inversia.operators.filters import REGION
from inversia.plans import jobs, resume
from inversia.queries.views import COLUMN_SQL, GRID_SQL, POINT_SQL, ROW_SQL, Query, grid, points, r, rounded, table
from inversia.session import scratch_path
from inversia.sources import raster, sinks

# -- rasters written from the given tables ---------------------------------------------------------
# One grid file per day: 24 rows (hours) by 15 columns (user_id % 15) of summed whole values.
WEST, NORTH, DX, DY = -90.3, 39.61, 0.61, 0.17
HEADER_TEXT = (
    "BYTEORDER      I\nLAYOUT       BIL\nNROWS         {rows}\nNCOLS         {cols}\nNBANDS        1\nNBITS         32\n"
    "PIXELTYPE     FLOAT\nULXMAP        {west}\nULYMAP        {north}\nXDIM          {dx}\nYDIM          {dy}\nNODATA        -9999\n"
)


def _write_group(folder: str, rows: int, cols: int):
    """Write one small grid: a task's group holds the cells of one file (rows x cols at most)."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        band = np.full((rows, cols), -9999, dtype="<f4")
        band[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf["v"].to_numpy()
        name = pdf["name"].iloc[0]
        target = folder if "://" in folder or not folder.startswith("file:") else "file:///" + folder[5:].lstrip("/")
        filesystem, inner = pafs.FileSystem.from_uri(target)
        filesystem.create_dir(inner, recursive=True)
        header = HEADER_TEXT.format(rows=rows, cols=cols, west=WEST, north=NORTH, dx=DX, dy=DY)
        for ending, content in ((".bil", band.tobytes()), (".hdr", header.encode())):
            with filesystem.open_output_stream(f"{inner}/{name}{ending}") as f:
                f.write(content)
        return pd.DataFrame({"name": [name]})

    return write


def write_rasters(cells, rows: int, cols: int, folder: str) -> str:
    """``cells`` (name, row, col, v) as one .bil and .hdr per name."""
    written = cells.groupBy("name").applyInPandas(_write_group(folder, rows, cols), "name string")
    written.count()
    return folder


def _daily_cells(spark, folder):
    events = table(spark, folder, "events")
    day = F.date_format("ts", "yyyyMMdd")
    return events.groupBy(
        F.concat(F.lit("grid_tmean_us_30s_"), day).alias("name"), F.hour("ts").alias("row"), (F.col("user_id") % 15).cast("int").alias("col")
    ).agg(F.sum(F.floor("value")).cast("double").alias("v"))


def _daily(spark, folder):
    return write_rasters(_daily_cells(spark, folder), 24, 15, scratch_path(spark, "grids"))


CELLS_SQL = (
    "c AS (SELECT strftime(ts, '%Y%m%d') AS day, cast(date_trunc('day', ts) AS timestamp) AS t, hour(ts) AS row, user_id % 15 AS col, "
    "sum(floor(value)) AS v FROM events GROUP BY ALL)"
)
LON_OF, LAT_OF = f"{WEST}e0 + col * {DX}e0", f"{NORTH}e0 - row * {DY}e0"
# columns and rows whose centres lie in the region, and the window's width
WINDOW = f"{LON_OF} BETWEEN {REGION['lon'][0]} AND {REGION['lon'][1]} AND {LAT_OF} BETWEEN {REGION['lat'][0]} AND {REGION['lat'][1]}"


def _span_sql():
    cols = [c for c in range(15) if REGION["lon"][0] <= WEST + c * DX <= REGION["lon"][1]]
    rows = [x for x in range(24) if REGION["lat"][0] <= NORTH - x * DY <= REGION["lat"][1]]
    return cols[0], len(cols), rows[0]


COL0, WIDTH, ROW0 = _span_sql()


def _cells(spark, folder, **options):
    cells = raster.read_rasters(spark, _daily(spark, folder), **options)
    return rounded(cells.select("name", "variable", "pixel", "longitude", "latitude", F.col("value").cast("double").alias("value"), "timestamp"))


def _cells_sql(pixel, where):
    return (
        f"WITH {CELLS_SQL} SELECT concat('grid_tmean_us_30s_', day, '.bil') AS name, 'tmean' AS variable, {pixel} AS pixel, "
        f"{r(LON_OF, 'longitude')}, {r(LAT_OF, 'latitude')}, cast(v AS double) AS value, t AS \"timestamp\" FROM c WHERE {where}"
    )


def _converted(spark, folder, part="points"):
    found = jobs.convert_rasters(spark, _daily(spark, folder), grid(spark, folder), every=3)
    return found[part]


CONVERTED_SQL = (
    f"WITH {CELLS_SQL}, g AS ({GRID_SQL}), p AS (SELECT day, t, row, col, v, {LON_OF} AS lon, {LAT_OF} AS lat, (row - {ROW0}) * {WIDTH} + col - {COL0} AS pixel "
    f"FROM c WHERE {WINDOW} AND ((row - {ROW0}) * {WIDTH} + col - {COL0}) % 3 = 0), "
    "q AS (SELECT DISTINCT row, col, lon, lat FROM p), "
    "z AS (SELECT row, col, arg_min(z, ((q.lat - g.lat) * (q.lat - g.lat) + (q.lon - g.lon) * (q.lon - g.lon), lat_idx, lon_idx)) AS altitude FROM q, g GROUP BY row, col) "
)


def _resumed(spark, folder):
    """Files that arrive in two parts, converted by two runs, the second one after a run that broke."""
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "converted")
    cells, odd = _daily_cells(spark, folder), F.substring("name", -2, 2).cast("int") % 2 == 1
    write_rasters(cells.where(odd), 24, 15, source)
    resume.convert_new_rasters(spark, source, target, grid(spark, folder), every=3)
    write_rasters(cells.where(~odd), 24, 15, source)
    # what a broken run leaves: points that no manifest names
    broken = resume.read_points(spark, target).limit(50).withColumn("altitude", F.lit(-1.0))
    broken.write.partitionBy("variable", "year").parquet(f"{target}/{resume.POINTS}/run=00000002-broken")
    again = resume.convert_new_rasters(spark, source, target, grid(spark, folder), every=3)
    first = resume.committed(spark, target).join(again["converted"].select("path"), "path", "left_anti").count()
    return resume.read_points(spark, target).withColumn("converted_before", F.lit(first))


def _normals(spark, folder):
    """Twelve month files of order counts by year and weekday; two cells in three are empty."""
    orders = table(spark, folder, "orders")
    cells = orders.groupBy(
        F.concat(F.lit("normal_"), F.date_format("o_orderdate", "MM")).alias("name"),
        (F.year("o_orderdate") - 1995).alias("row"),
        F.weekday("o_orderdate").alias("col"),
    ).agg(F.count("*").cast("double").alias("v"))
    path = write_rasters(cells.where("(row + col) % 3 = 0"), 7, 7, scratch_path(spark, "normals"))
    out = raster.read_monthly_normals(spark, path)
    return rounded(out.withColumn("value", F.col("value").cast("double")))


NORMALS_SQL = (
    "WITH c AS (SELECT month(o_orderdate) AS m, year(o_orderdate) - 1995 AS row, isodow(o_orderdate) - 1 AS col, count(*) AS v FROM orders GROUP BY ALL), "
    "f AS (SELECT month, row, col FROM (SELECT DISTINCT m AS month FROM c WHERE (row + col) % 3 = 0), (SELECT unnest(range(7)) AS row), (SELECT unnest(range(7)) AS col)) "
    f"SELECT cast(month AS int) AS month, f.row * 7 + f.col AS pixel, {r(f'{WEST}e0 + f.col * {DX}e0', 'longitude')}, {r(f'{NORTH}e0 - f.row * {DY}e0', 'latitude')}, "
    "cast(v AS double) AS value FROM f LEFT JOIN c ON f.month = c.m AND f.row = c.row AND f.col = c.col AND (f.row + f.col) % 3 = 0"
)


# -- terrain ---------------------------------------------------------------------------------------
def _brute(points_sql, extra=""):
    return (
        f"WITH p AS ({points_sql}), g AS ({GRID_SQL}), n AS (SELECT c_custkey, arg_min({{'z': z, 'lat': lat, 'lon': lon}}, "
        "((latitude - lat) * (latitude - lat) + (longitude - lon) * (longitude - lon), lat_idx, lon_idx)) AS b, any_value(latitude) AS latitude, "
        f"any_value(longitude) AS longitude, any_value(c_nationkey) AS c_nationkey, any_value(c_acctbal) AS c_acctbal FROM p, g GROUP BY c_custkey) {extra}"
    )


MIDPOINT_ROWS, MIDPOINT_COLUMNS = "c_custkey % 40", "c_custkey % 19"
MIDPOINT_LAT = f"36.0e0 + ({MIDPOINT_ROWS}) * 0.0625e0 + 0.03125e0"
MIDPOINT_LON = f"-90.5e0 + ({MIDPOINT_COLUMNS}) * 0.5e0 + 0.25e0"
EXACT_GRID_SQL = (
    f"SELECT {ROW_SQL} AS lat_idx, {COLUMN_SQL} AS lon_idx, 36.0e0 + {ROW_SQL} * 0.0625e0 AS lat, "
    f"-90.5e0 + ({COLUMN_SQL}) * 0.5e0 AS lon, p_retailprice AS z FROM part"
)


def _midpoints(spark, folder):
    """Points exactly between two rows and two columns of a grid, through both lookups."""
    cells = table(spark, folder, "part").select(
        F.expr(ROW_SQL).alias("lat_idx"), F.expr(COLUMN_SQL).alias("lon_idx"),
        F.expr(f"36.0e0 + {ROW_SQL} * 0.0625e0").alias("lat"), F.expr(f"-90.5e0 + ({COLUMN_SQL}) * 0.5e0").alias("lon"), F.col("p_retailprice").alias("z"),
    )
    between = table(spark, folder, "customer").select(
        "c_custkey", F.expr(MIDPOINT_LAT).cast("double").alias("latitude"), F.expr(MIDPOINT_LON).cast("double").alias("longitude")
    )
    ways = {"search": {}, "order": {"max_axis": 0, "rows_per_chunk": 400}}
    parts = [
        spatial.nearest_grid_point(between, cells, **options).select(F.lit(way).alias("way"), "c_custkey", "altitude", "grid_lat", "grid_lon")
        for way, options in ways.items()
    ]
    return parts[0].unionByName(parts[1])


MIDPOINTS_SQL = (
    f"WITH p AS (SELECT c_custkey, {MIDPOINT_LAT} AS latitude, {MIDPOINT_LON} AS longitude FROM customer), g AS ({EXACT_GRID_SQL}), "
    "a AS (SELECT lat, min(lat_idx) AS i FROM g GROUP BY lat), o AS (SELECT lon, min(lon_idx) AS i FROM g GROUP BY lon), "
    "ra AS (SELECT latitude, arg_min(lat, (abs(latitude - lat), i)) AS grid_lat, arg_min(i, (abs(latitude - lat), i)) AS lat_idx FROM (SELECT DISTINCT latitude FROM p), a GROUP BY latitude), "
    "ro AS (SELECT longitude, arg_min(lon, (abs(longitude - lon), i)) AS grid_lon, arg_min(i, (abs(longitude - lon), i)) AS lon_idx FROM (SELECT DISTINCT longitude FROM p), o GROUP BY longitude) "
    "SELECT way, c_custkey, z AS altitude, grid_lat, grid_lon FROM p JOIN ra USING (latitude) JOIN ro USING (longitude) "
    "LEFT JOIN g ON g.lat_idx = ra.lat_idx AND g.lon_idx = ro.lon_idx, (SELECT unnest(['search', 'order']) AS way)"
)


def _with_altitude(spark, folder):
    return spatial.add_altitude(points(spark, folder), grid(spark, folder))


def _enriched(spark, folder):
    """Point tables on disk, enriched into a new folder."""
    source, target = scratch_path(spark, "plain"), scratch_path(spark, "enriched")
    sinks.write_table(points(spark, folder), source, "csv")
    jobs.enrich_points(spark, source, grid(spark, folder), target)
    back = spark.read.option("header", True).csv(target)
    return back.select(F.col("c_custkey").cast("bigint"), F.col("altitude").cast("double"))


def _keyed(spark, folder):
    return _with_altitude(spark, folder).select(
        (F.col("c_custkey") + 1).alias("key"), "altitude", F.lit(0.0).alias("dist"), "latitude", "longitude", F.col("c_acctbal").alias("tmean")
    )


def _sample_json(spark, folder):
    """The point sample as JSON records, read again."""
    records = spatial.as_json(spatial.point_sample(_keyed(spark, folder), "tmean", 10))
    return records.select(F.from_json("record", "id int, value double, altitude double").alias("r")).select("r.*")


# -- scattered terrain: half of it in one small square ------------------------------------------------
SCATTER_LAT = "CASE WHEN p_partkey % 2 = 0 THEN 37.5e0 + sqrt((p_partkey * 7.7e0) % 11.0e0) * 0.0001e0 ELSE 36.0e0 + sqrt((p_partkey * 31.3e0) % 12.0e0) END"
SCATTER_LON = "CASE WHEN p_partkey % 2 = 0 THEN -85.0e0 + sqrt((p_partkey * 5.3e0) % 13.0e0) * 0.0001e0 ELSE -90.5e0 + sqrt((p_partkey * 77.1e0) % 85.0e0) END"
SCATTER_SQL = f"SELECT p_partkey AS idx, {SCATTER_LAT} AS lat, {SCATTER_LON} AS lon, p_retailprice AS z FROM part"
# every third cell has lost its altitude, and every fifth is absent
HOLED_SQL = f"SELECT lat_idx, lon_idx, lat, lon, CASE WHEN (lat_idx + 2 * lon_idx) % 3 <> 0 THEN z END AS z FROM ({GRID_SQL}) WHERE (lat_idx + lon_idx) % 5 <> 0"


def _scattered(spark, folder):
    part = table(spark, folder, "part")
    return part.select(F.col("p_partkey").alias("idx"), F.expr(SCATTER_LAT).alias("lat"), F.expr(SCATTER_LON).alias("lon"), F.col("p_retailprice").alias("z"))


def _holed(spark, folder):
    cells = grid(spark, folder).where("(lat_idx + lon_idx) % 5 <> 0")
    return cells.withColumn("z", F.expr("CASE WHEN (lat_idx + 2 * lon_idx) % 3 <> 0 THEN z END"))


def _near_sql(k):
    d = "(longitude - lon) * (longitude - lon) + (latitude - lat) * (latitude - lat)"
    return (
        f"WITH p AS ({POINT_SQL}), g AS ({SCATTER_SQL}), n AS (SELECT c_custkey, idx, z, {d} AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY {d}, idx) AS rank FROM p, g) "
        f"SELECT c_custkey, cast(rank AS int) AS rank, idx AS target_idx, z AS altitude, {r('sqrt(d)', 'distance', 9)} FROM n WHERE rank <= {k}"
    )


def _near(k):
    def run(spark, folder):
        found = nearest.nearest_points(points(spark, folder), _scattered(spark, folder), k, most=16)
        return found.select("c_custkey", "rank", "target_idx", "altitude", F.round("distance", 9).alias("distance"))

    return run


HOLES_SQL = (
    f"WITH p AS ({POINT_SQL}), g AS ({HOLED_SQL}), a AS (SELECT lat, min(lat_idx) AS i FROM g GROUP BY lat), o AS (SELECT lon, min(lon_idx) AS i FROM g GROUP BY lon), "
    "c AS (SELECT c_custkey, latitude, longitude, arg_min(a.i, (abs(latitude - lat), a.i)) AS lat_idx FROM p, a GROUP BY ALL), "
    "e AS (SELECT c.*, arg_min(o.i, (abs(longitude - lon), o.i)) AS lon_idx FROM c, o GROUP BY ALL), "
    "f AS (SELECT e.c_custkey, latitude, longitude, g.z, g.lat, g.lon FROM e LEFT JOIN g USING (lat_idx, lon_idx)), "
    "h AS (SELECT c_custkey, arg_min(struct_pack(z := g.z, lat := g.lat, lon := g.lon), ((longitude - g.lon) * (longitude - g.lon) + (latitude - g.lat) * (latitude - g.lat), lat_idx, lon_idx)) AS b "
    "FROM f, g WHERE f.z IS NULL AND g.z IS NOT NULL GROUP BY c_custkey) "
    f"SELECT c_custkey, coalesce(f.z, b.z) AS altitude, {r('CASE WHEN f.z IS NULL THEN b.lat ELSE f.lat END', 'grid_lat')}, {r('CASE WHEN f.z IS NULL THEN b.lon ELSE f.lon END', 'grid_lon')} FROM f LEFT JOIN h USING (c_custkey)"
)

# -- kernel density -------------------------------------------------------------------------------------
CELL = 0.25
DENSITY_SQL = (
    f"WITH p AS ({POINT_SQL}), c AS (SELECT cast(floor(longitude / {CELL}e0) AS bigint) AS i, cast(floor(latitude / {CELL}e0) AS bigint) AS j, sum(c_acctbal) AS w, sum(c_acctbal * c_acctbal) AS s "
    "FROM p WHERE c_acctbal > 0 GROUP BY ALL), "
    f"m AS (SELECT sum(w) AS t, sum(s) / (sum(w) * sum(w)) AS share, sum(w * i * {CELL}e0) / sum(w) AS mx, sum(w * j * {CELL}e0) / sum(w) AS my FROM c), "
    f"b AS (SELECT t, pow(1 / share, -1 / 6e0) * sqrt(sum(w * (i * {CELL}e0 - mx) * (i * {CELL}e0 - mx)) / t / (1 - share)) AS bx, "
    f"pow(1 / share, -1 / 6e0) * sqrt(sum(w * (j * {CELL}e0 - my) * (j * {CELL}e0 - my)) / t / (1 - share)) AS bw FROM c, m GROUP BY t, share), "
    f"k AS (SELECT *, cast(ceil(bx / {CELL}e0 * sqrt(2 * ln(1e9))) AS bigint) AS rx, cast(ceil(bw / {CELL}e0 * sqrt(2 * ln(1e9))) AS bigint) AS ry FROM b), "
    "x AS (SELECT DISTINCT i + d AS x FROM c, (SELECT unnest(range(-rx, rx + 1)) AS d FROM k)), y AS (SELECT DISTINCT j + d AS y FROM c, (SELECT unnest(range(-ry, ry + 1)) AS d FROM k)), "
    # a cell is reached if a cell of points is near along both axes
    "q AS (SELECT x, y FROM x, y), "
    f"e AS (SELECT x, y, sum(w * exp(-((x - i) * {CELL}e0 / bx) * ((x - i) * {CELL}e0 / bx) / 2 - ((y - j) * {CELL}e0 / bw) * ((y - j) * {CELL}e0 / bw) / 2)) / (2 * pi() * bx * bw * t) AS v, "
    "bool_or(abs(x - i) <= rx AND abs(y - j) <= ry) AS reached FROM q, c, k GROUP BY x, y, bx, bw, t) "
    f"SELECT x AS lon_cell, y AS lat_cell, {r('v', 'density')} FROM e WHERE reached AND v > 1e-3"
)


QUERIES: dict[str, Query] = {
    "nearest_point": Query(_near(1), _near_sql(1)),
    "nearest_points_k": Query(_near(5), _near_sql(5)),
    "nearest_known_cell": Query(
        lambda s, d: rounded(nearest.nearest_known_cell(points(s, d), _holed(s, d)).select("c_custkey", "altitude", "grid_lat", "grid_lon")), HOLES_SQL
    ),
    "kernel_density": Query(lambda s, d: rounded(density.kernel_density(points(s, d).where("c_acctbal > 0"), "c_acctbal", CELL).where("density > 1e-3")), DENSITY_SQL),
    "raster_cells": Query(lambda s, d: _cells(s, d, every=2), _cells_sql("row * 15 + col", "(row * 15 + col) % 2 = 0")),
    "raster_region": Query(
        lambda s, d: _cells(s, d, region=REGION, every=3),
        _cells_sql(f"(row - {ROW0}) * {WIDTH} + col - {COL0}", f"{WINDOW} AND ((row - {ROW0}) * {WIDTH} + col - {COL0}) % 3 = 0"),
    ),
    "monthly_normals": Query(_normals, NORMALS_SQL),
    "raster_conversion": Query(
        lambda s, d: rounded(_converted(s, d).select("key", "altitude", "dist", "hr", "latitude", "longitude", F.col("value").cast("double").alias("value"), "timestamp", "year")),
        CONVERTED_SQL
        + f"SELECT row_number() OVER (PARTITION BY day ORDER BY pixel) AS key, {r('altitude', 'altitude')}, 0.0e0 AS dist, 0.0e0 AS hr, {r('lat', 'latitude')}, {r('lon', 'longitude')}, "
        'cast(v AS double) AS value, t AS "timestamp", cast(year(t) AS int) AS year FROM p JOIN z ON p.row = z.row AND p.col = z.col',
    ),
    "raster_conversion_resumed": Query(
        lambda s, d: rounded(_resumed(s, d).select("key", "altitude", "latitude", "longitude", F.col("value").cast("double").alias("value"), "timestamp", "year", "converted_before")),
        CONVERTED_SQL
        + f"SELECT row_number() OVER (PARTITION BY day ORDER BY pixel) AS key, {r('altitude', 'altitude')}, {r('lat', 'latitude')}, {r('lon', 'longitude')}, "
        'cast(v AS double) AS value, t AS "timestamp", cast(year(t) AS int) AS year, (SELECT count(DISTINCT day) FROM c WHERE cast(right(day, 2) AS int) % 2 = 1) AS converted_before '
        "FROM p JOIN z ON p.row = z.row AND p.col = z.col",
    ),
    "raster_run_report": Query(
        lambda s, d: _converted(s, d, "report"),
        CONVERTED_SQL
        + "SELECT cast(left(day, 4) AS int) AS year, count(DISTINCT day) AS files, 0 AS failed, "
        f"count(*) FILTER ({WINDOW} AND ((row - {ROW0}) * {WIDTH} + col - {COL0}) % 3 = 0) AS points FROM c GROUP BY 1",
    ),
    "thin_grid": Query(
        lambda s, d: rounded(spatial.thin_grid(grid(s, d), 3)),
        f"SELECT lat_idx, lon_idx, {r('lat', 'lat')}, {r('lon', 'lon')}, z FROM ({GRID_SQL}) WHERE lat_idx % 3 = 0 AND lon_idx % 3 = 0",
    ),
    "nearest_grid_point": Query(
        lambda s, d: rounded(spatial.nearest_grid_point(points(s, d), grid(s, d))),
        _brute(
            POINT_SQL,
            f"SELECT c_custkey, c_nationkey, c_acctbal, {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, b.z AS altitude, {r('b.lat', 'grid_lat')}, "
            f"{r('b.lon', 'grid_lon')}, {r('sqrt((latitude - b.lat) * (latitude - b.lat) + (longitude - b.lon) * (longitude - b.lon))', 'distance')} FROM n",
        ),
    ),
    "nearest_grid_point_long_axis": Query(
        lambda s, d: spatial.nearest_grid_point(points(s, d), grid(s, d), max_axis=0, rows_per_chunk=400).select("c_custkey", "altitude"),
        _brute(POINT_SQL, "SELECT c_custkey, b.z AS altitude FROM n"),
    ),
    "nearest_grid_point_midpoints": Query(_midpoints, MIDPOINTS_SQL),
    "altitude_stats": Query(
        lambda s, d: rounded(spatial.altitude_stats(_with_altitude(s, d), ["c_nationkey"])),
        _brute(
            POINT_SQL,
            f"SELECT c_nationkey, {r('min(b.z)', 'min_altitude')}, {r('max(b.z)', 'max_altitude')}, {r('avg(b.z)', 'mean_altitude')} FROM n GROUP BY c_nationkey",
        ),
    ),
    "enrich_points": Query(_enriched, _brute(POINT_SQL, "SELECT c_custkey, b.z AS altitude FROM n")),
    "point_sample": Query(
        lambda s, d: rounded(spatial.point_sample(_keyed(s, d), "tmean", 10)),
        _brute(
            POINT_SQL,
            f"SELECT cast(c_custkey + 1 AS int) AS id, {r('longitude', 'longitude')}, {r('latitude', 'latitude')}, c_acctbal AS value, b.z AS altitude, 0.0e0 AS dist FROM n WHERE c_custkey < 10",
        ),
    ),
    "point_sample_json": Query(_sample_json, _brute(POINT_SQL, "SELECT cast(c_custkey + 1 AS int) AS id, c_acctbal AS value, b.z AS altitude FROM n WHERE c_custkey < 10")),
    "point_metadata": Query(
        lambda s, d: spatial.with_metadata(
            table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value")),
            table(s, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"),
        ),
        "SELECT c_nationkey AS key, c_custkey AS id, c_acctbal AS value, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "field_metrics": Query(
        lambda s, d: rounded(spatial.field_metrics(points(s, d).withColumnRenamed("c_acctbal", "ppt"), "ppt", ["c_nationkey"])).withColumn("total", F.round("total", 2)),
        f"SELECT c_nationkey, min(c_acctbal) AS min, max(c_acctbal) AS max, {r('avg(c_acctbal)', 'mean')}, {r('median(c_acctbal)', 'median')}, "
        f"{r('stddev_samp(c_acctbal)', 'std')}, {r('sum(c_acctbal)', 'total', 2)} FROM customer GROUP BY c_nationkey",
    ),
    "field_metrics_whole": Query(
        lambda s, d: rounded(spatial.field_metrics(table(s, d, "lineitem"), "l_extendedprice"), 4),
        f"SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, {r('avg(l_extendedprice)', 'mean', 4)}, {r('median(l_extendedprice)', 'median', 4)}, "
        f"{r('stddev_samp(l_extendedprice)', 'std', 4)}, cast(NULL AS double) AS total FROM lineitem",
    ),
    "extent": Query(
        lambda s, d: rounded(spatial.extent(points(s, d))),
        f"SELECT {r('min(longitude) - 0.1', 'min_lon')}, {r('min(latitude) - 0.1', 'min_lat')}, {r('max(longitude) + 0.1', 'max_lon')}, {r('max(latitude) + 0.1', 'max_lat')} FROM ({POINT_SQL})",
    ),
    "weighted_density": Query(
        lambda s, d: rounded(spatial.weighted_density(points(s, d), "c_acctbal", 0.5)),
        f"WITH c AS (SELECT cast(floor(longitude / 0.5) AS bigint) AS lon_cell, cast(floor(latitude / 0.5) AS bigint) AS lat_cell, sum(c_acctbal) AS w FROM ({POINT_SQL}) GROUP BY ALL) "
        f"SELECT lon_cell, lat_cell, {r('w', 'weight')}, {r('w / (SELECT sum(w) FROM c)', 'density')} FROM c",
    ),
}
