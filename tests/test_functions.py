"""Hand-computed values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from inversia.functions import calendar, weather
from inversia.functions.coercion import finite, number, parse_time, with_parsed_time
from inversia.sources import manifest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_number_and_finite(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("-3",)], "t string")
    assert [r[0] for r in rows.select(number(F.col("t"))).collect()] == [1.5, None, None, None, -3.0]
    real = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "x double")
    assert [r[0] for r in real.select(finite(F.col("x"))).collect()] == [1.0, None, None, None, None]


def test_times(spark):
    text = ["2024-01-02 03:04:05", "2024/01/02 03:04:05", "01/02/2024 03:04:05", "2024-01-02", "13/02/2024", "Timestamp", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = [None if r[0] is None else str(r[0]) for r in df.select(parse_time(F.col("t"))).collect()]
    assert got == ["2024-01-02 03:04:05"] * 3 + ["2024-01-02 00:00:00", "2024-02-13 00:00:00", None, None]
    assert with_parsed_time(df, "t").count() == 5


def test_flags_and_classes(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (0.0,), (2.0,), (5.0,), (5.1,)], "x double")
    rows = df.select(weather.flag(F.col("x") > 0), weather.strength_code(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 1, 1, 1]
    assert [r[1] for r in rows] == [None, 0, 1, 2, 3, 4]


def test_physics(spark):
    t, rh, p = F.lit(20.0), F.lit(50.0), F.lit(1000.0)
    got = one(
        spark,
        weather.saturation_pressure(t),
        weather.vapour_pressure(t, rh),
        weather.virtual_temperature(t, rh, p),
        weather.potential_temperature(F.lit(25.0), F.lit(950.0)),
        weather.potential_temperature(F.lit(25.0), F.lit(0.0)),
        weather.saturation_pressure(F.lit(None).cast("double")),
    )
    assert [round(x, 6) for x in got[:4]] == [23.369471, 11.684736, 20.142554, 25.369450]
    assert got[4] is None and got[5] is None


def test_wind_and_ratio(spark):
    wind = weather.wind_components(F.lit(5.0), F.lit(90.0))
    u, v, null = one(spark, wind["wind_u"], wind["wind_v"], weather.ratio(F.lit(1.0), F.lit(0.0)))
    assert u == pytest.approx(-5) and v == pytest.approx(0, abs=1e-12) and null is None


def test_calendar(spark):
    ts = F.lit("2024-03-02 06:00:00").cast("timestamp_ntz")
    parts = {**calendar.calendar_parts(ts), **calendar.season_columns(ts)}
    row = one(spark, *[c.alias(n) for n, c in parts.items()]).asDict()
    assert (row["hour"], row["day_of_year"], row["month"], row["day_of_week"], row["is_weekend"]) == (6, 62, 3, 5, 1)
    assert (row["season_numeric"], row["season_spring"], row["season_winter"]) == (1, 1, 0)
    sin, cos = one(spark, *list(calendar.cyclic_columns(ts).values())[:2])
    assert sin == pytest.approx(1) and cos == pytest.approx(0, abs=1e-12)


def test_seasons_of_all_months(spark):
    got = [r[0] for r in spark.range(1, 13).orderBy("id").select(calendar.season_name(F.col("id").cast("int"))).collect()]
    assert got == ["winter"] * 2 + ["spring"] * 3 + ["summer"] * 3 + ["fall"] * 3 + ["winter"]


def test_names_and_maturity(spark):
    df = spark.createDataFrame([("grid_tmean_us_30s_20210101.bil",), ("readme.txt",), ("a_b_c_d_20211301.bil",)], "n string")
    rows = manifest.parse_names(df, "n").collect()
    assert len(rows) == 1
    assert [rows[0][k] for k in ("product", "variable", "region", "resolution")] == ["grid", "tmean", "us", "30s"]
    assert str(rows[0]["date"]) == "2021-01-01"
    as_of = F.to_date(F.lit("2024-07-10"))
    ages = [manifest.maturity(F.to_date(F.lit(d)), as_of) for d in ("2024-07-01", "2024-06-30", "2024-02-01", "2024-01-31")]
    assert list(one(spark, *ages)) == ["early", "provisional", "provisional", "stable"]
    years = [manifest.maturity_of_year(F.lit(y), as_of) for y in (2023, 2024)]
    assert list(one(spark, *years)) == ["stable", "provisional"]


def test_kelvin(spark):
    got = one(spark, *[manifest.kelvin_to_celsius(F.lit(v), F.lit(300.0)) for v in ("t2m", "TMP", "rh")])
    assert [round(x, 2) for x in got] == [26.85, 26.85, 300.0]
