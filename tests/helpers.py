"""Small fixtures shared by the tests."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import DataFrame, SparkSession

from inversia.plans.series import SeriesSpec

START = dt.datetime(2024, 1, 1)
SPEC = SeriesSpec(("site",), "ts", ("id",))


def series(spark: SparkSession, *columns: list, names: str = "v", minutes: int = 30, site: str = "A") -> DataFrame:
    """One site, one row per step, the given value columns."""
    labels = names.split(",")
    rows = [
        (site, START + dt.timedelta(minutes=minutes * i), i, *[float(x) if isinstance(x, (int, float)) else x for x in vals])
        for i, vals in enumerate(zip(*columns))
    ]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, id bigint, " + ", ".join(f"{n} double" for n in labels))


def values(df: DataFrame, column: str = "v") -> list:
    return [None if r[0] is None else round(r[0], 6) for r in df.orderBy("ts", "id").select(column).collect()]


def hot_table(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    """Three sites, the first with two thirds of all rows, bursts in time and runs of nulls."""
    rng = random.Random(seed)
    data, t = [], {"hot": START, "b": START, "c": START}
    hole = 0
    for i in range(rows):
        site = rng.choices(["hot", "b", "c"], [4, 1, 1])[0]
        burst = 1 if (i // 100) % 2 else 3000
        t[site] += dt.timedelta(seconds=rng.choice([1, 2, 5]) * burst)
        hole = hole - 1 if hole else (rng.randrange(1, 40) if rng.random() < 0.04 else 0)
        v = None if hole else round(5 * math.sin(i / 9) + rng.uniform(-1, 1), 3)
        u = None if rng.random() < 0.3 else round(rng.uniform(0, 360), 2)
        data.append((site, t[site], i, v, u))
    return spark.createDataFrame(data, "site string, ts timestamp_ntz, id bigint, v double, u double")


def same(a: DataFrame, b: DataFrame, digits: int = 9) -> bool:
    def rows(df):
        out = []
        for r in df.select(*sorted(df.columns)).collect():
            out.append(tuple(round(x, digits) if isinstance(x, float) else x for x in r))
        return sorted(out, key=repr)

    return rows(a) == rows(b)
