"""Grid points, the nearest-grid-point join, and summaries of point fields.

The terrain grid is rectilinear, so the nearest cell of a point is the nearest latitude and the
nearest longitude, found apart. An axis is tiny next to its grid; once its length is checked it
goes to the driver and each point finds its place by binary search, with no shuffle. The terrain
itself is then an ordinary equi-join that Spark may broadcast or, if it is large, shuffle with
skew handling. Axes too long for the driver are merged with the points in coordinate order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.operators.quantiles import exact_quantiles
from inversia.plans.layout import plan_layout
from inversia.plans.series import ROWS_PER_CHUNK, SeriesSpec

MAX_AXIS = 200_000
RAIN_NAMES = ("ppt", "precipitation")


def thin_grid(grid: DataFrame, every: int) -> DataFrame:
    """Every n-th latitude and longitude of a long grid table."""
    return grid.where((F.col("lat_idx") % every == 0) & (F.col("lon_idx") % every == 0))


def _axis(grid: DataFrame, name: str) -> DataFrame:
    """Distinct coordinates of one axis; of equal coordinates the smallest index."""
    known = grid.where(F.col(name).isNotNull())
    return known.groupBy(F.col(name).cast("double").alias("_v")).agg(F.min(f"{name}_idx").cast("bigint").alias("_i"))


def _nearer(value: Column, low: Column, high: Column) -> Column:
    """The nearer of two neighbours (``at``, ``i``) on an axis; equally near: the smaller index."""
    to_low, to_high = value - low["at"], high["at"] - value
    lower = high.isNull() | (to_low < to_high) | ((to_low == to_high) & (low["i"] < high["i"]))
    return F.when(low.isNotNull() & lower, low).otherwise(high)


def _nearest_by_search(points: DataFrame, column: str, name: str, axis: list) -> DataFrame:
    """Binary search among the coordinates of a checked, driver-side axis for the two that a point
    lies between."""
    axis = sorted((r["_v"], r["_i"]) for r in axis)
    place, value = f"_place_{name}", f"_x_{name}"
    found = points.withColumn(value, F.col(column).cast("double"))
    # interval k begins at coordinate k - 1 and ends before coordinate k
    splits = [-math.inf, *[v for v, _ in axis], math.inf]
    if len(axis):
        search = Bucketizer(splits=splits, inputCol=value, outputCol=place, handleInvalid="keep")
        found = search.transform(found.withColumn(value, F.coalesce(value, F.lit(math.nan))))
    else:
        found = found.withColumn(place, F.lit(0.0))
    ends = [None, *axis, None]
    lookup = points.sparkSession.createDataFrame(
        [(float(k), ends[k] and (ends[k][0], ends[k][1]), ends[k + 1] and (ends[k + 1][0], ends[k + 1][1])) for k in range(len(axis) + 1)],
        f"`{place}` double, _low struct<at: double, i: bigint>, _high struct<at: double, i: bigint>",
    )
    best = _nearer(F.col(value), F.col("_low"), F.col("_high"))
    joined = found.join(F.broadcast(lookup), place, "left")
    return joined.withColumns({f"_{name}_idx": best["i"], f"grid_{name}": best["at"]}).drop(place, value, "_low", "_high")


def _nearest_by_order(points: DataFrame, column: str, name: str, axis: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Merge the distinct coordinates of the points with the axis in order and take the nearer
    neighbour; then look each point's coordinate up. Works for any axis length: the merged order
    is cut into chunks like a long series, and a coordinate that many points share is one row."""
    spec = SeriesSpec((), "_v", rows_per_chunk=rows_per_chunk)
    asked = points.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    hits = axis.select("_v", F.struct(F.col("_v").alias("at"), F.col("_i").cast("bigint").alias("i")).alias("_hit"))
    merged = asked.withColumn("_ask", F.lit(True)).join(hits, "_v", "full_outer")
    layout = plan_layout(merged, spec)
    near = layout.own(layout.carry(layout.spread(merged), ["_hit"])).where("_ask")
    best = _nearer(F.col("_v"), F.col("_prev__hit"), F.col("_next__hit"))
    found = near.select(F.col("_v").alias("_x"), best["i"].alias(f"_{name}_idx"), best["at"].alias(f"grid_{name}"))
    return points.join(found, F.col(column).cast("double") == F.col("_x"), "left").drop("_x")


def nearest_grid_point(
    points: DataFrame,
    grid: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    max_axis: int = MAX_AXIS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the nearest grid cell of every point: ``altitude``, ``grid_lat``, ``grid_lon`` and
    ``distance`` (degrees, not scaled with latitude)."""
    out = points
    for column, name in ((lat, "lat"), (lon, "lon")):
        axis = _axis(grid, name)
        head = axis.limit(max_axis + 1).collect()
        if len(head) <= max_axis:
            out = _nearest_by_search(out, column, name, head)
        else:
            out = _nearest_by_order(out, column, name, axis, rows_per_chunk)
    cells = grid.select(
        F.col("lat_idx").cast("bigint").alias("_lat_idx"),
        F.col("lon_idx").cast("bigint").alias("_lon_idx"),
        F.col("z").alias("altitude"),
    )
    d_lat, d_lon = F.col(lat) - F.col("grid_lat"), F.col(lon) - F.col("grid_lon")
    joined = out.drop("altitude").join(cells, ["_lat_idx", "_lon_idx"], "left")
    kept = [c for c in points.columns if c != "altitude"]
    return joined.select(
        *kept, "altitude", "grid_lat", "grid_lon", F.sqrt(d_lat * d_lat + d_lon * d_lon).alias("distance")
    )


def add_altitude(points: DataFrame, grid: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The join without its details."""
    return nearest_grid_point(points, grid, lat, lon).drop("grid_lat", "grid_lon", "distance")


def altitude_stats(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(
        F.min("altitude").alias("min_altitude"),
        F.max("altitude").alias("max_altitude"),
        F.avg("altitude").alias("mean_altitude"),
    )


def point_sample(points: DataFrame, value: str, first: int = 10) -> DataFrame:
    """The first points by key as flat records."""
    return points.where(F.col("key") <= first).select(
        F.col("key").cast("int").alias("id"),
        *[F.col(c).cast("double").alias(n) for c, n in (
            ("longitude", "longitude"), ("latitude", "latitude"), (value, "value"), ("altitude", "altitude"), ("dist", "dist")
        )],
    )


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def with_metadata(values: DataFrame, metadata: DataFrame, key: str = "key") -> DataFrame:
    """Values joined to their point's metadata on the key."""
    return values.join(metadata, key)


def field_metrics(df: DataFrame, value: str, by: Sequence[str] = (), rain: Column | None = None) -> DataFrame:
    """Min, max, mean, exact median and sample deviation of a value column; the total for
    precipitation only, since sums of other fields mean nothing."""
    is_rain = F.lit(value.lower() in RAIN_NAMES) if rain is None else rain
    keyed = df.withColumn("_rain", is_rain)
    stats = keyed.groupBy(*by).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.sum(value).alias("_sum"),
        F.bool_or("_rain").alias("_rain"),
    )
    medians = exact_quantiles(df, [value], {"median": 0.5}, by).drop("variable")
    joined = stats.join(medians, list(by)) if by else stats.withColumn("median", F.lit(medians.first()["median"]))
    return joined.select(*by, "min", "max", "mean", "median", "std", F.when(F.col("_rain"), F.col("_sum")).alias("total"))


def extent(df: DataFrame, lat: str = "latitude", lon: str = "longitude", buffer: float = 0.1) -> DataFrame:
    """Bounding box of the points, widened by a buffer."""
    return df.agg(
        (F.min(lon) - buffer).alias("min_lon"),
        (F.min(lat) - buffer).alias("min_lat"),
        (F.max(lon) + buffer).alias("max_lon"),
        (F.max(lat) + buffer).alias("max_lat"),
    )


def weighted_density(
    df: DataFrame, weight: str, cell: float, lat: str = "latitude", lon: str = "longitude", by: Sequence[str] = ()
) -> DataFrame:
    """Share of the total weight that falls in each square cell (of each group)."""
    cells = df.groupBy(
        *by, F.floor(F.col(lon) / cell).alias("lon_cell"), F.floor(F.col(lat) / cell).alias("lat_cell")
    ).agg(F.sum(weight).alias("weight"))
    if not by:
        total = cells.agg(F.sum("weight")).first()[0]
        return cells.withColumn("density", F.try_divide(F.col("weight"), F.lit(total)))
    totals = cells.groupBy(*by).agg(F.sum("weight").alias("_total"))
    return cells.join(totals, list(by)).withColumn("density", F.try_divide("weight", "_total")).drop("_total")
