"""Neighbours among scattered points and cells against comparing all pairs, and kernel density."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inversia.operators import density, nearest


def scattered(spark, rng, n=400):
    """Half of all targets in one tiny square, some in equal places, some without a coordinate or value."""
    rows = []
    for i in range(n):
        if i % 2:
            x, y = 0.5 + rng.random() * 1e-5, 0.5 + rng.random() * 1e-5
        else:
            x, y = rng.uniform(-50, 50), rng.uniform(-3, 3)
        if i % 17 == 0:
            x, y = 1.0, 1.0
        rows.append((i, None if i % 50 == 7 else y, float("nan") if i % 50 == 9 else x, None if i % 50 == 11 else float(i)))
    return spark.createDataFrame(rows, "idx long, lat double, lon double, z double").repartition(3)


def brute(points, targets, k):
    ok = [t for t in targets if t.lat is not None and not math.isnan(t.lon) and t.z is not None]
    out = []
    for p in points:
        if p.latitude is None or p.longitude is None:
            out.append((p.id, None, None, None))
            continue
        near = sorted(((t.lon - p.longitude) ** 2 + (t.lat - p.latitude) ** 2, t.idx, t.z) for t in ok)[:k]
        out += [(p.id, rank, i, round(math.sqrt(d), 9)) for rank, (d, i, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,most,sent", [(1, 8, True), (5, 4, False)])
def test_equal_to_all_pairs(spark, monkeypatch, k, most, sent):
    if not sent:
        monkeypatch.setattr(nearest, "MOST_SENT", 0)
    rng = random.Random(k)
    targets = scattered(spark, rng)
    rows = [(i, rng.choice([rng.uniform(-4, 4), 0.5, 1.0]), rng.choice([rng.uniform(-60, 60), 0.5, 1.0]), "kept", 1) for i in range(120)]
    rows += [(200, None, 1.0, "kept", 1), (201, 1.0, None, "kept", 1)] + [(300 + i, 0.5, 0.5, "kept", 1) for i in range(30)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double, altitude string, x int").repartition(4)
    got = nearest.nearest_points(points, targets, k, most=most)
    assert got.columns == ["id", "latitude", "longitude", "x", "rank", "target_idx", "altitude", "target_lat", "target_lon", "distance"]
    found = sorted(((r.id, r["rank"], r.target_idx, r.distance and round(r.distance, 9)) if r["rank"] else (r.id, None, None, None) for r in got.collect()), key=repr)
    assert [(a, b, c, d or (0.0 if b else None)) for a, b, c, d in found] == brute(points.collect(), targets.collect(), k)


def test_few_or_no_targets(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, None, None)], "id long, latitude double, longitude double")
    one = spark.createDataFrame([(4, 1.0, 2.5, 7.0)], "idx long, lat double, lon double, z double")
    got = {r.id: (r["rank"], r.altitude, r.distance) for r in nearest.nearest_points(points, one, 3).collect()}
    assert got == {1: (1, 7.0, 0.5), 2: (None, None, None)}
    assert [r.altitude for r in nearest.nearest_points(points, one.where("false")).collect()] == [None, None]
    assert nearest.nearest_points(points.where("false"), one).collect() == []


def test_squares_looked_into_are_few(spark):
    """Points beside a crowded place don't meet all that is in it."""
    rng = random.Random(2)
    targets = spark.createDataFrame([(i, rng.random() * 1e-3, rng.random() * 1e-3, 1.0) for i in range(4000)], "idx long, lat double, lon double, z double")
    known = targets.select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("idx").alias("i"), "z")
    tables, _ = nearest._squares(known, (0.0, 0.0, 1e-3), 32)
    asked = spark.createDataFrame([(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(200)], "qx double, qy double")
    reached = nearest._search(asked, tables, 1)
    assert reached.agg(F.sum("n")).first()[0] < 200 * 4000 / 10


def test_holes_in_a_grid(spark):
    rows = [(i, j, 10.0 * i, 10.0 * j, None if (i, j) in {(1, 1), (2, 2)} else float(10 * i + j)) for i in range(4) for j in range(4) if (i, j) != (0, 3)]
    grid = spark.createDataFrame(rows, "lat_idx int, lon_idx int, lat double, lon double, z double")
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 1.0, 29.0), (3, 31.0, 0.0), (4, None, 1.0), (5, 19.0, 21.0)], "id long, latitude double, longitude double")
    got = {r.id: (r.altitude, r.grid_lat, r.grid_lon) for r in nearest.nearest_known_cell(points, grid).collect()}
    assert got[1] == (1.0, 0.0, 10.0) and got[3] == (30.0, 30.0, 0.0) and got[4][0] is None
    assert got[2] == (2.0, 0.0, 20.0) and got[5] == (12.0, 10.0, 20.0)


def test_density_is_the_direct_sum_and_one_in_all(spark):
    rng = random.Random(6)
    rows = [(rng.gauss(0, 2), rng.gauss(10, 1), rng.choice([0.0, 1.0, 3.0, None])) for _ in range(300)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "longitude double, latitude double, w double")
    out = {(r.lon_cell, r.lat_cell): r.density for r in density.kernel_density(df, "w", 0.25, width=(0.8, 0.5)).collect()}
    assert math.isclose(sum(out.values()) * 0.25**2, 1, abs_tol=1e-6)
    cells = {}
    for x, y, w in rows:
        if x is not None and w:
            key = (math.floor(x / 0.25), math.floor(y / 0.25))
            cells[key] = cells.get(key, 0) + w
    total = sum(cells.values())
    for i, j in list(out)[::200]:
        want = sum(w * math.exp(-(((i - a) * 0.25 / 0.8) ** 2 + ((j - b) * 0.25 / 0.5) ** 2) / 2) for (a, b), w in cells.items()) / (2 * math.pi * 0.8 * 0.5 * total)
        assert math.isclose(out[i, j], want, abs_tol=1e-8)
    assert density.kernel_density(df.limit(0), "w", 0.25).collect() == []
    assert density.kernel_density(df.where("w = 3").limit(1), "w", 0.25).collect() == []
