"""How the sensor roles are read from the given tables.

The expressions are plain SQL that both Spark and the checking engine read, so that query and
check start from the same numbers. Square roots keep values away from rounding ties."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inversia.plans.series import SeriesSpec

SITE, TIME = "NetSiteAbbrev", "UTCTimestampCollected"
SENSOR_SQL = {
    "TAIR": "CASE WHEN event_type = 'error' THEN NULL ELSE sqrt(value * 3.0 + 5.0) - 4.0 END",
    "DWPT": "sqrt(value * 2.0 + 1.0) - 5.0",
    "PRES": "980.0 + sqrt((value * 17.0) % 900.0)",
    "RELH": "CASE WHEN event_type = 'click' THEN NULL ELSE 10.0 + sqrt((value * 13.7) % 8000.0) END",
    "SRAD": "sqrt((value * 11.3) % 900.0) * 7.0",
    "WSPD": "sqrt(value) * 1.1",
    "WDIR": "CASE WHEN event_type = 'view' THEN NULL ELSE sqrt((value * 3737.0) % 129600.0) END",
    "PRCP": "CASE WHEN event_type = 'signup' THEN NULL ELSE sqrt((value * 0.7) % 3.0) END",
    "SM02": "sqrt((value * 1.9) % 0.5)",
    "SM04": "sqrt((value * 2.3) % 0.5)",
    "ST02": "sqrt(value * 1.3 + 2.0)",
    "ST04": "sqrt(value * 1.1 + 3.0)",
    "VT05": "2.0 + sqrt((value * 3.1) % 60.0 + 1.0)",
    "VT20": "2.5 + sqrt((value * 5.3) % 55.0 + 1.5)",
    "VT90": "3.0 + sqrt((value * 7.3) % 50.0 + 2.0)",
    "VR05": "CASE WHEN event_type = 'view' THEN sqrt(value) ELSE NULL END",
}
SENSORS = tuple(SENSOR_SQL)
STATION_SQL = (
    f"SELECT cast(user_id AS string) AS {SITE}, ts AS {TIME}, event_id, event_type, "
    + ", ".join(f"{e} AS {n}" for n, e in SENSOR_SQL.items())
    + " FROM events"
)
SPEC = SeriesSpec((SITE,), TIME, ("event_id",))
# five long series, cut into many chunks, so that the checks also cover cut series
HOT = SeriesSpec(("event_type",), TIME, ("event_id",), rows_per_chunk=500)

LAT_SQL = "36.0e0 + sqrt((c_custkey * 37.7e0) % 13.0e0)"
LON_SQL = "-90.5e0 + sqrt((c_custkey * 91.3e0) % 90.0e0)"
POINT_SQL = f"SELECT c_custkey, c_nationkey, c_acctbal, {LAT_SQL} AS latitude, {LON_SQL} AS longitude FROM customer"
ROW_SQL, COLUMN_SQL = "cast(floor(p_partkey / 20) AS bigint)", "p_partkey % 20"
GRID_LAT_SQL, GRID_LON_SQL = f"36.0e0 + {ROW_SQL} * 0.0373e0", f"-90.5e0 + ({COLUMN_SQL}) * 0.5113e0"
GRID_SQL = (
    f"SELECT {ROW_SQL} AS lat_idx, {COLUMN_SQL} AS lon_idx, {GRID_LAT_SQL} AS lat, {GRID_LON_SQL} AS lon, p_retailprice AS z FROM part"
)
LINES = SeriesSpec(("l_returnflag",), "l_shipdate", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
LINE_KEYS = ("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@dataclass(frozen=True)
class Query:
    """A query over the given tables, and the SQL that checks it (None: rows only)."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def station(spark: SparkSession, folder: str, sensors: Sequence[str] = SENSORS) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("string").alias(SITE),
        F.col("ts").alias(TIME),
        "event_id",
        "event_type",
        *[F.expr(SENSOR_SQL[c]).cast("double").alias(c) for c in sensors],
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    return customer.select(
        "c_custkey", "c_nationkey", "c_acctbal", F.expr(LAT_SQL).alias("latitude"), F.expr(LON_SQL).alias("longitude")
    )


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """A terrain of one cell per part: its longitudes repeat, its latitudes grow with the table."""
    part = table(spark, folder, "part")
    return part.select(
        F.expr(ROW_SQL).alias("lat_idx"),
        F.expr(COLUMN_SQL).alias("lon_idx"),
        F.expr(GRID_LAT_SQL).alias("lat"),
        F.expr(GRID_LON_SQL).alias("lon"),
        F.col("p_retailprice").alias("z"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as the checks do. Hours are one division of whole
    microseconds, the same in every engine, and stay as they are."""
    real = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float") and not f.name.endswith("_hours")}
    return df.select(*[F.round(c, digits).alias(c) if c in real else F.col(c) for c in df.columns])


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) AS {name}"


def with_station(body: str) -> str:
    return f"WITH st AS ({STATION_SQL}) {body}"
