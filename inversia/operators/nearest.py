"""Nearest neighbours of points among scattered points, and of grids with holes.

The targets are cut into squares; a square with more than ``most`` of them is cut again, so crowded
places have small squares and empty ones large. All points look for their neighbours together, level
by level: each keeps the squares that may still hold one of its nearest, which is a join with the
squares inside those it kept. A square's count and bounding box say how far its farthest target can
be; once squares with k targets are known, everything beyond the farthest of them is out of reach. So
a point looks into a few squares however many targets there are, and a crowded square costs only the
points near it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.operators.spatial import nearest_grid_point
from inversia.plans.joins import match
from inversia.session import staged

#: Targets of a square that isn't cut, cuts per side at once (as a power of two) and in all.
MOST, STEP, DEEPEST = 64, 2, 26
#: Tables of squares are sent to every task up to so many bytes; larger ones are shuffled.
MOST_SENT, SQUARE_BYTES = 32 << 20, 96
#: Distances that differ by less than this share count as possibly equal while searching.
MARGIN = 1 + 1e-9


def _place(value: str, low: float, side: float, level: int) -> Column:
    return F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(side) * F.lit(float(1 << level))), F.lit((1 << level) - 1)).cast("long")


def _squares(targets: DataFrame, box: tuple[float, float, float], most: int) -> tuple[list[DataFrame], DataFrame]:
    """For every level the squares inside each square of the level above, and all targets with the
    square (``level``, ``cx``, ``cy``) that holds them."""
    x0, y0, side = box
    tables, leaves, rows = [], [], targets
    for level in range(STEP, DEEPEST + 1, STEP):
        placed = rows.withColumns({"cx": _place("x", x0, side, level), "cy": _place("y", y0, side, level)})
        sums = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for i, f in ((1, F.min), (2, F.max)) for c in ("x", "y")])
        sums = staged(sums.withColumn("leaf", (F.col("n") <= most) | F.lit(level + STEP > DEEPEST)), "squares")
        inside = F.struct(F.lit(level).alias("level"), "cx", "cy", "n", "x1", "x2", "y1", "y2", "leaf")
        by_parent = sums.groupBy(F.shiftright("cx", STEP).alias("px"), F.shiftright("cy", STEP).alias("py")).agg(F.collect_list(inside).alias("inside"))
        tables.append(staged(by_parent, "squares"))  # 16 squares at most in each
        crowded = sums.where("NOT leaf").select("cx", "cy")
        many = crowded.count()
        small = F.broadcast(crowded) if many * SQUARE_BYTES <= MOST_SENT else crowded
        leaves.append((placed.join(small, ["cx", "cy"], "left_anti") if many else placed).withColumn("level", F.lit(level)))
        if not many:
            break
        rows = staged(placed.join(small, ["cx", "cy"], "left_semi").drop("cx", "cy"), "crowded")
    return tables, reduce(DataFrame.unionByName, leaves)


def _reach(k: int) -> Column:
    """The smallest distance within which the squares in ``_f`` surely hold k targets; null if they
    hold fewer."""
    by_far = F.array_sort(F.transform("_f", lambda c: F.struct(c["far"].alias("far"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("far"))

    def add(a: Column, c: Column) -> Column:
        return F.struct((a["n"] + c["n"]).alias("n"), F.when(a["far"].isNotNull(), a["far"]).when(a["n"] + c["n"] >= k, c["far"]).alias("far"))

    return F.aggregate(by_far, start, add)["far"]


def _search(asked: DataFrame, tables: list[DataFrame], k: int) -> DataFrame:
    """``qx``, ``qy`` and ``_f``: the uncut squares that may hold one of the point's k nearest."""
    out = lambda q, low, high: F.greatest(low - q, q - high, F.lit(0.0))
    off = lambda q, low, high: F.greatest(F.abs(q - low), F.abs(q - high))
    x, y = F.col("qx"), F.col("qy")

    def measured(c: Column) -> Column:
        dx, dy, ex, ey = out(x, c["x1"], c["x2"]), out(y, c["y1"], c["y2"]), off(x, c["x1"], c["x2"]), off(y, c["y1"], c["y2"])
        return F.struct(*[c[n].alias(n) for n in ("level", "cx", "cy", "n", "leaf")], (dx * dx + dy * dy).alias("near"), (ex * ex + ey * ey).alias("far"))

    state, done = asked.withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")}), None
    for table in tables:
        small = F.broadcast(table) if table.count() * 16 * SQUARE_BYTES <= MOST_SENT else table
        met = state.join(small, ["px", "py"]).select("qx", "qy", F.inline(F.transform("inside", measured)))
        found = met if done is None else met.unionByName(done)
        each = F.struct("level", "cx", "cy", "n", "leaf", "near", "far")
        gathered = found.groupBy("qx", "qy").agg(F.collect_list(each).alias("_f")).withColumn("_reach", _reach(k))  # a few squares' squares
        near = F.filter("_f", lambda c: F.col("_reach").isNull() | (c["near"] <= F.col("_reach") * MARGIN))
        kept = staged(gathered.select("qx", "qy", F.inline(near)), "reached")
        done = kept.where("leaf")
        state = kept.where("NOT leaf").select("qx", "qy", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return done


def nearest_points(
    points: DataFrame,
    targets: DataFrame,
    k: int = 1,
    lat: str = "latitude",
    lon: str = "longitude",
    target_lat: str = "lat",
    target_lon: str = "lon",
    index: str = "idx",
    value: str = "z",
    most: int = MOST,
) -> DataFrame:
    """Every point with its ``k`` nearest targets: ``rank`` from 1, ``target_idx``, ``altitude`` (the
    target's value), ``target_lat``, ``target_lon``, ``distance`` (degrees, not scaled with latitude).

    Equally near targets come by ``index``, which tells targets apart. Targets without a coordinate
    or a value are no targets; fewer than k give fewer rows. A point without coordinates, or without
    any target, is one row of nulls. Columns of the points with those names are replaced."""
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    made = ("rank", "target_idx", "altitude", "target_lat", "target_lon", "distance")
    known = targets.select(number(target_lon).alias("x"), number(target_lat).alias("y"), F.col(index).alias("i"), F.col(value).alias("z")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    # no more than k targets of one place are ever wanted
    alike = F.row_number().over(Window.partitionBy("x", "y").orderBy("i"))
    known = staged(known.withColumn("_n", alike).where(F.col("_n") <= k).drop("_n"), "targets")
    ends = known.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    rest = points.select(*[c for c in points.columns if c not in made])
    here = rest.withColumns({"_qx": number(lon), "_qy": number(lat)})
    if ends[0] is None:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(made, ("int", known.schema["i"].dataType, known.schema["z"].dataType, "double", "double", "double"))]
        return rest.select("*", *nothing)
    side = max(ends[2] - ends[0], ends[3] - ends[1]) or 1.0
    tables, leaves = _squares(known, (ends[0], ends[1], side), most)
    # a place that many points share is looked for once
    asked = staged(here.select(F.col("_qx").alias("qx"), F.col("_qy").alias("qy")).where("qx IS NOT NULL AND qy IS NOT NULL").distinct(), "asked")
    reached = _search(asked, tables, k).select("qx", "qy", "level", "cx", "cy")
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    met = reached.join(staged(leaves, "targets"), ["level", "cx", "cy"]).select("qx", "qy", "x", "y", "i", "z", (dx * dx + dy * dy).alias("d"))
    place = F.row_number().over(Window.partitionBy("qx", "qy").orderBy("d", "i"))  # the targets of a few squares
    best = staged(met.withColumn("rank", place).where(F.col("rank") <= k), "nearest")
    best = best.select(F.col("qx").alias("_qx"), F.col("qy").alias("_qy"), "rank", F.col("i").alias("target_idx"), F.col("z").alias("altitude"), F.col("y").alias("target_lat"), F.col("x").alias("target_lon"), F.sqrt("d").alias("distance"))
    return here.join(best, ["_qx", "_qy"], "left").select(*rest.columns, *made)


def nearest_known_cell(points: DataFrame, grid: DataFrame, lat: str = "latitude", lon: str = "longitude", keys: Sequence[str] = ()) -> DataFrame:
    """The nearest-grid-point join for grids with holes: where the nearest cell is absent or has no
    altitude, the nearest cell that has one (of equals the first by latitude index, then longitude).
    ``altitude``, ``grid_lat``, ``grid_lon``, ``distance``; rows without coordinates have nulls."""
    first = staged(nearest_grid_point(points, grid, lat, lon), "first")
    holes = first.where(F.col("altitude").isNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if holes.isEmpty():
        return first
    cells = grid.withColumn("_place", F.struct(F.col("lat_idx"), F.col("lon_idx")))
    again = nearest_points(holes.drop("grid_lat", "grid_lon"), cells, 1, lat, lon, "lat", "lon", "_place")
    filled = again.withColumnsRenamed({"target_lat": "grid_lat", "target_lon": "grid_lon"}).select(*first.columns)
    rest = first.where(F.col("altitude").isNotNull() | F.col(lat).isNull() | F.col(lon).isNull())
    return rest.unionByName(filled)
