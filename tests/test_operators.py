"""Hand-computed fixtures and invariants of the table operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from inversia.operators import filters, impute, modeling, quality, spatial, windows
from inversia.plans import jobs
from inversia.plans.series import SeriesSpec
from inversia.sources import stations
from tests.helpers import SPEC, START, hot_table, series, values

GAPPY = [None] * 3 + [1] + [None] * 6 + [8] + [None] * 3


def test_linear_fill_from_both_sides(spark):
    got = values(impute.linear_fill(series(spark, GAPPY), SPEC, ["v"], 2))
    assert got == [None, 1, 1, 1, 2, 3, None, None, 6, 7, 8, 8, 8, None]


def test_forward_backward_fill(spark):
    df = series(spark, GAPPY)
    assert values(impute.forward_backward_fill(df, SPEC, ["v"], 2)) == [None, 1, 1, 1, 1, 1, None, None, 8, 8, 8, 8, 8, None]
    rain = impute.forward_backward_fill(df, SPEC, ["v"], 2, precipitation=["v"])
    assert values(rain) == [None] * 3 + [1, 1, 1] + [None] * 4 + [8, 8, 8, None]


def test_circular_fill(spark):
    got = values(impute.circular_fill(series(spark, [350, None, 10]), SPEC, ["v"]))
    assert [math.cos(math.radians(a - b)) for a, b in zip(got, [350, 0, 10])] == pytest.approx([1, 1, 1])
    assert all(0 <= x < 360.000001 for x in got)


def test_constants_and_statistics(spark):
    df = series(spark, [1, None, 4, 10])
    assert values(impute.zero_fill(df, ["v"])) == [1, 0, 4, 10]
    assert values(impute.mean_fill(df, ["v"])) == [1, 5, 4, 10]
    assert values(impute.median_fill(df, ["v"])) == [1, 4, 4, 10]
    assert values(impute.fill_all(series(spark, [None, 1, None, 2, None]), SPEC, ["v"])) == [1, 1, 1, 2, 2]


def test_fills_keep_known_cells_and_stay_in_range(spark):
    table = hot_table(spark, 300)
    filled = impute.linear_fill(table, SPEC, ["v"], 5).withColumnRenamed("v", "w")
    both = table.join(filled.select("id", "w"), "id").agg(
        F.count(F.when(F.col("v").isNotNull() & ~F.col("v").eqNullSafe(F.col("w")), 1)),
        F.count("v") <= F.count("w"),
        F.min("v") <= F.min("w"),
        F.max("w") <= F.max("v"),
    ).first()
    assert list(both) == [0, True, True, True]


def test_rolling(spark):
    out = windows.add_rolling(series(spark, [1, 2, None, 4, 5, 6]), SPEC, ["v"], [3])
    assert values(out, "v_rolling_mean_3") == [None] * 5 + [5]
    assert values(out, "v_rolling_std_3")[-1] == 1
    out = windows.add_rolling(series(spark, [2, 4, 4, 4]), SPEC, ["v"], [3])
    assert values(out, "v_rolling_mean_3") == [None, None, 3.333333, 4]
    assert values(out, "v_rolling_std_3") == [None, None, 1.154701, 0]
    assert values(out, "v_rolling_change_3") == [None, None, None, 2]


def test_turn_and_steps(spark):
    out = windows.add_differences(series(spark, [350, 10, 200, 20], [1, 4, 9, 16], names="WDIR,TAIR"), SPEC)
    assert values(out, "wind_direction_change") == [None, 20, -170, -180]
    assert values(out, "temp_acceleration") == [None, None, 2, 2]
    assert values(out, "temp_change_3h") == [None, None, None, 15]


def test_events(spark):
    df = series(spark, [1, 3, -1, None, 2, 2, -3])
    rows = windows.inversion_events(df, SPEC, F.col("v")).orderBy("start_time").collect()
    assert [(r.n_steps, r.max_inversion_strength, r.avg_inversion_strength, r.season) for r in rows] == [(2, 3, 2, "winter"), (2, 2, 2, "winter")]
    assert rows[0].elapsed_hours == 0.5 and "site" in df.columns
    one = windows.event_summary(df, SPEC, F.col("v")).first()
    assert (one.steps, one.inversion_steps, one.events, one.strongest, one.average_strength) == (7, 4, 2, 3, 2)


def test_time_gaps(spark):
    minutes = [0, 30, 65, 105, 135, 315]
    df = spark.createDataFrame([("A", START + dt.timedelta(minutes=m), m) for m in minutes], "site string, ts timestamp_ntz, id bigint")
    gaps = quality.time_gaps(df, SPEC).orderBy("gap").collect()
    assert [(g.gap, g.gap_end - START, g.missing_records_est) for g in gaps] == [
        (1, dt.timedelta(minutes=105), 0), (2, dt.timedelta(minutes=315), 5)
    ]
    periods = quality.continuous_periods(df, SPEC).orderBy("period").collect()
    assert [(p.record_count, p.duration_hours) for p in periods] == [(3, 65 / 60), (2, 0.5), (1, 0.0)]
    total = quality.completeness(df, SPEC).first()
    assert (total.periods, total.span_hours) == (3, 5.25)
    assert total.data_hours + total.gap_hours == pytest.approx(5.25)
    assert total.longest_start == START


def test_single_row_site_and_duplicates(spark):
    rows = [("A", START, 1, 1.0), ("A", START, 2, None), ("A", START, 3, 3.0), ("B", START, 4, None)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, id bigint, v double")
    assert {r.site: r.completeness_pct for r in quality.completeness(df, SPEC).collect()} == {"A": None, "B": None}
    got = impute.linear_fill(df, SPEC, ["v"]).orderBy("id").collect()
    assert [r.v for r in got] == [1, 2, 3, None]


def test_missing_runs_and_chunks(spark):
    df = series(spark, [1, None, None, 2, None], [1, 1, None, 1, 1], names="a,b")
    got = quality.gap_analysis(df, SPEC, ["a", "b"]).orderBy("variable").collect()
    assert [(r.total_missing, r.number_of_gaps, r.max_gap_length, r.avg_gap_length) for r in got] == [(3, 2, 2, 1.5), (1, 1, 1, 1.0)]
    chunks = quality.complete_chunks(df, SPEC, ["a", "b"]).orderBy("start_row").collect()
    assert [(c.start_row, c.end_row, c.n_rows) for c in chunks] == [(0, 0, 1), (3, 3, 1)]
    gap = quality.chunk_gaps(df, SPEC, ["a", "b"]).collect()
    assert [(g.start_row, g.end_row) for g in gap] == [(1, 2)]


def test_missing_log_keeps_the_raw_text(spark):
    raw = spark.createDataFrame([("A", START, 0, "1"), ("A", START, 1, "bad"), ("A", START, 2, None)], "site string, ts timestamp_ntz, id bigint, x string")
    got = quality.missing_log(raw, SPEC, ["x"]).orderBy("Row_Index").collect()
    assert [(r.Row_Index, r.Original_Value, r.Missing_Type) for r in got] == [(1, "bad", "Non-numeric_converted"), (2, None, "Already_missing")]


def test_raw_exports_of_two_layouts(spark, tmp_path):
    """Two files of one folder, their columns in another order, units rows and text times."""
    (tmp_path / "a.csv").write_text("NetSiteAbbrev,County,UTCTimestampCollected,TAIR,RELH\n,,UTC,C,%\nA,x,2024-01-01 00:05:00,2,60\nA,x,2024-01-01 00:00:00,1,bad\n")
    (tmp_path / "b.csv").write_text("RELH,TAIR,UTCTimestampCollected,NetSiteAbbrev,County\n70,3,01/02/2024 00:00:00,B,y\n71,,2024-01-03 00:00:00,B,y\n")
    assert len(stations.header_groups(spark, str(tmp_path))) == 2
    raw = stations.read_raw_stations(spark, str(tmp_path))
    typed = stations.type_stations(raw)
    got = {(r.NetSiteAbbrev, r.TAIR, r.RELH) for r in typed.collect()}
    assert got == {("A", 2.0, 60.0), ("A", 1.0, None), ("B", 3.0, 70.0), ("B", None, 71.0)}
    found = jobs.cleaning_job(raw, typed, jobs.STATION, ["TAIR", "RELH"])
    log = {(r.Column, r.Original_Value, r.Row_Index, r.DateTime) for r in found["log"].collect()}
    assert log == {
        ("TAIR", "C", 0, "UTC"), ("RELH", "%", 0, "UTC"), ("RELH", "bad", 0, "2024-01-01 00:00:00"), ("TAIR", None, 1, "2024-01-03 00:00:00"),
    }
    values = [(r.Column, r.Seen_No, r.Value) for r in found["raw_values"].orderBy("Column", "Seen_No").collect()]
    assert values[:2] == [("RELH", 1, "%"), ("RELH", 2, "bad")]
    assert found["complete"].count() == 2 and found["incomplete"].count() == 2
    assert found["chunks"].count() == 2 and found["availability"].count() == 2


def test_run_folder_is_cleared_by_its_owner(spark):
    import os

    from inversia.session import run_folder, staged

    table = staged(spark.range(3), "three")
    assert table.count() == 3 and any(n.startswith("three-") for n in os.listdir(run_folder(spark).removeprefix("file:")))


def test_numeric_only_keeps_ids(spark):
    df = spark.createDataFrame([("A", "x", "7", 1.0)], "NetSiteAbbrev string, note string, n string, v double")
    assert filters.numeric_only(df).columns == ["NetSiteAbbrev", "v"]
    assert filters.coerce_leftovers(df).select("note", "n").first() == (None, 7.0)


def test_feature_selection(spark):
    df = spark.createDataFrame([("A", 1.0, None, 2.0, "w", "t", 0.0)], "NetSiteAbbrev string, a double, b double, a_target_1h double, season_x string, note string, inversion_strength double")
    assert filters.select_features(df) == ["a", "season_x"]


def test_outliers_with_no_spread(spark):
    df = series(spark, [5, 5, None, 5])
    assert filters.drop_outliers(df, "v", ["site"]).count() == 3
    assert filters.drop_outliers(df, "v").count() == 3


def test_extremes(spark):
    df = series(spark, [1, 2, 3, 4])
    assert values(windows.clean_extremes(df, ["v"], ["v"], cap_trigger=3.5))[-1] == 3.997
    assert values(windows.clean_extremes(df, ["v"], ["v"])) == [1, 2, 3, 4]


def test_scores_and_best(spark):
    rows = [("s", "t", "m", y, p) for y, p in ((1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0))]
    rows += [("s", "t", "n", y, 2.5) for y in (1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "site string, target string, model string, label double, prediction double")
    got = {r.model: r for r in modeling.scores(df, ["site", "target", "model"]).collect()}
    assert (got["m"].rmse, got["m"].mae, round(got["m"].r2, 9)) == (1, 0.5, 0.2)
    best = modeling.best_models(modeling.scores(df, ["site", "target", "model"])).first()
    assert (best.model, best.rmse) == ("m", 1)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert modeling.scores(flat).first().r2 is None


def test_folds_split_and_thinning(spark):
    df = series(spark, list(range(13)))
    folds = modeling.contiguous_folds(df, SPEC).orderBy("id").select("fold").collect()
    assert [r[0] for r in folds] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 2 + [4] * 2
    assert modeling.chronological_split(df, SPEC).where("is_train").count() == 10
    eleven = series(spark, list(range(11)))
    assert values(modeling.thin(eleven, SPEC, 4)) == [0, 3, 6, 10]
    assert modeling.thin(eleven, SPEC, 20).count() == 11


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a, b = (sorted(r[0] for r in modeling.sample_rows(d, ["id"], 37).collect()) for d in (df, df.repartition(7)))
    assert len(a) == 37 and a == b


def grid_of(spark):
    return spark.createDataFrame(
        [(0, 0, 37.0, -85.0, 100.0), (1, 0, 37.1, -85.0, 110.0), (0, 1, 37.0, -84.9, 120.0), (1, 1, 37.1, -84.9, 130.0)],
        "lat_idx int, lon_idx int, lat double, lon double, z double",
    )


def test_nearest_tiny_grid(spark):
    points = spark.createDataFrame([(1, 37.04, -84.99), (2, 37.0, -84.91), (3, None, -85.0)], "id int, latitude double, longitude double")
    for options in ({}, {"max_axis": 0}, {"max_axis": 0, "rows_per_chunk": 2}):
        got = spatial.nearest_grid_point(points, grid_of(spark), **options).orderBy("id").collect()
        assert [r.altitude for r in got] == [100, 120, None]
        assert got[0].distance == pytest.approx(math.hypot(0.04, 0.01))


@pytest.mark.parametrize("falling", [False, True])
def test_nearest_ties_go_to_the_smaller_index(spark, falling):
    sign = -1 if falling else 1
    grid = spark.createDataFrame(
        [(i, j, float(sign * i), float(j), float(10 * i + j)) for i in range(4) for j in range(3)],
        "lat_idx int, lon_idx int, lat double, lon double, z double",
    )
    points = spark.createDataFrame([(1, sign * 0.5, 1.5), (2, sign * 2.5, 0.5), (3, sign * 9.0, -4.0)], "id int, latitude double, longitude double")
    for options in ({}, {"max_axis": 0}):
        got = spatial.nearest_grid_point(points, grid, **options).orderBy("id").collect()
        assert [r.altitude for r in got] == [1, 20, 30]


@pytest.mark.parametrize("rows", [0, 1])
def test_nearest_on_a_grid_without_or_with_one_latitude(spark, rows):
    grid = grid_of(spark).where(F.col("lat_idx") < rows)
    points = spark.createDataFrame([(1, 40.0, -84.99), (2, 30.0, -80.0), (3, None, -85.0)], "id int, latitude double, longitude double")
    for options in ({}, {"max_axis": 0}):
        got = spatial.nearest_grid_point(points, grid, **options).orderBy("id").collect()
        assert [r.altitude for r in got] == ([100, 120, None] if rows else [None] * 3)


def test_both_lookups_agree_next_to_midpoints(spark):
    """Decimal steps have no exact midpoints; points a rounding away from them tell the rules apart."""
    grid = spark.createDataFrame([(i, 0, 36.0 + i * 0.0373, -85.0, float(i)) for i in range(60)], "lat_idx int, lon_idx int, lat double, lon double, z double")
    rows = []
    for i in range(59):
        middle = (36.0 + i * 0.0373 + 36.0 + (i + 1) * 0.0373) / 2
        rows += [(3 * i + k, x, -85.0) for k, x in enumerate((math.nextafter(middle, 0), middle, math.nextafter(middle, 99)))]
    points = spark.createDataFrame(rows, "id int, latitude double, longitude double")
    a, b = (spatial.nearest_grid_point(points, grid, **o).orderBy("id").collect() for o in ({}, {"max_axis": 0}))
    assert a == b


def test_feature_build_columns(spark):
    sensors = [f for f in impute.SENSORS if not f.startswith("VR")]
    df = series(spark, *[[float(i % 7 + k) for i in range(30)] for k in range(len(sensors))], names=",".join(sensors))
    spec = SeriesSpec(("site",), "ts", ("id",))
    out = jobs.build_features(df, spec)
    made = [c for c in out.columns if c not in df.columns]
    assert len([c for c in made if "_lag_" in c]) == 50
    assert len([c for c in made if "_rolling_" in c]) == 150
    assert len([c for c in made if "_target_" in c]) == 20
    assert len(made) == 280
    assert out.count() == 30


def test_wild_sensor_is_capped(spark):
    v = [float(i) for i in range(40)]
    wild = v[:-1] + [1e32]
    df = series(spark, wild, v, v, v, names="TAIR,VT05,VT20,VT90")
    out = jobs.build_features(df, SPEC)
    top = out.agg(F.max("TAIR")).first()[0]
    assert top < 1e32 and out.where(F.col("TAIR_lag_1").isNotNull()).count() == 39
