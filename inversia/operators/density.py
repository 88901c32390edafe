"""Kernel density of weighted points.

Points are summed into square cells first; what is smoothed is the table of cells, which doesn't grow
with the points. A Gaussian over two axes is the product of two over one, so the kernel is applied in
two passes, each of which gives a cell's weight to the cells up to ``reach`` away along one axis. The
reach is where what is cut off falls under a stated share of the whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.session import staged


def bandwidths(cells: DataFrame, cell: float) -> tuple[float, float] | None:
    """Scott's rule over the cells: the weighted deviation of each axis times ``n^(-1/6)``, n being
    the effective number of points. None without weight or spread."""
    w, x, y = F.col("weight"), F.col("lon_cell") * cell, F.col("lat_cell") * cell
    sums = [F.sum(w), F.sum("squares"), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y)]
    total, squares, sx, sy, sxx, syy = cells.agg(*sums).first()
    if not total or not squares:
        return None
    share = squares / total**2
    if share >= 1:
        return None
    spread = [math.sqrt(max(ss / total - (s / total) ** 2, 0.0) / (1 - share)) for s, ss in ((sx, sxx), (sy, syy))]
    factor = (1 / share) ** (-1 / 6)
    return tuple(factor * s for s in spread) if min(spread) > 0 else None


def _steps(width: float, cell: float, cut: float) -> int:
    """Cells to go until the kernel has fallen to ``cut`` of its height."""
    return math.ceil(width / cell * math.sqrt(2 * math.log(1 / cut)))


def _smoothed(cells: DataFrame, axis: str, other: str, width: float, cell: float, steps: int) -> DataFrame:
    near = cells.withColumn("_k", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    d = F.col("_k") * F.lit(cell / width)
    height: Column = F.exp(-d * d / 2) / F.lit(width * math.sqrt(2 * math.pi))
    return near.select((F.col(axis) + F.col("_k")).alias(axis), other, (F.col("weight") * height).alias("weight")).groupBy(axis, other).agg(F.sum("weight").alias("weight"))


def kernel_density(
    df: DataFrame, weight: str, cell: float, lat: str = "latitude", lon: str = "longitude", width: tuple[float, float] | None = None, cut: float = 1e-9
) -> DataFrame:
    """``lon_cell``, ``lat_cell`` and ``density`` (per square degree) at the middle of every cell that
    the kernels reach; over the plane the density integrates to 1.

    ``width``: the deviations of the Gaussian along longitude and latitude; by default Scott's rule.
    A kernel ends where it has fallen to ``cut`` of its height, so densities are short of the whole
    sum by at most ``2 cut`` of a single kernel's peak. Rows without a coordinate or a positive weight
    don't count; without spread there is no density and no row."""
    known = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(weight) > 0))
    summed = known.groupBy(F.floor(F.col(lon) / cell).alias("lon_cell"), F.floor(F.col(lat) / cell).alias("lat_cell"))
    cells = staged(summed.agg(F.sum(weight).cast("double").alias("weight"), F.sum(F.col(weight) * F.col(weight)).cast("double").alias("squares")), "cells")
    width = width or bandwidths(cells, cell)
    total = cells.agg(F.sum("weight")).first()[0]
    if width is None or not total:
        return cells.limit(0).select("lon_cell", "lat_cell", F.col("weight").alias("density"))
    along = _smoothed(cells, "lon_cell", "lat_cell", width[0], cell, _steps(width[0], cell, cut))
    both = _smoothed(along, "lat_cell", "lon_cell", width[1], cell, _steps(width[1], cell, cut))
    return both.select("lon_cell", "lat_cell", (F.col("weight") / F.lit(total)).alias("density"))
