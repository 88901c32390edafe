"""Queries on scans, file names, spines, manifests and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inversia.functions.coercion import number, with_parsed_time
from inversia.plans import jobs
from inversia.queries.views import SITE, TIME, Query, points, r, rounded, station, table, with_station
from inversia.session import scratch_path
from inversia.sources import manifest, sinks, stations
from inversia.sources.stations import COUNTY

AS_OF = dt.date(1999, 6, 15)

NAME = "concat('grid_', CASE WHEN o_orderkey % 2 = 0 THEN 'tmean' ELSE 'ppt' END, '_us_30s_', {day}, CASE WHEN o_orderkey % 10 = 0 THEN '.csv' ELSE '.bil' END)"


def _files(spark, folder):
    orders = table(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "yyyyMMdd"))
    named = orders.select("o_orderkey", F.expr(NAME.format(day="day")).alias("name"), F.year("o_orderdate").alias("y"))
    return named.withColumn("path", F.concat(F.lit("/grids/tmean/daily/"), F.col("y").cast("string"), F.lit("/"), "name"))


FILES_SQL = f"f AS (SELECT o_orderkey, {NAME.format(day='''strftime(o_orderdate, '%Y%m%d')''')} AS name, year(o_orderdate) AS y, o_orderdate::date AS d FROM orders)"


def _times(spark, folder):
    """Times as text in several formats, with header words among them."""
    events = table(spark, folder, "events")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"]
    text = F.when(F.col("event_id") % 4 == 3, F.lit("Timestamp"))
    for i, form in enumerate(forms):
        text = text.when(F.col("event_id") % 4 == i, F.date_format("ts", form))
    parsed = with_parsed_time(events.select("event_id", text.alias("t")), "t")
    return parsed.select("event_id", F.col("t").cast("timestamp_ntz").alias("t"))


def _raw_export(spark, folder):
    """Write a raw export with units rows and two column orders; its folder."""
    st = station(spark, folder, ["TAIR", "RELH", "PRES"])
    text = st.select(
        SITE,
        F.lit("County").alias(COUNTY),
        F.date_format(TIME, "yyyy-MM-dd HH:mm:ss").alias(TIME),
        F.coalesce(F.format_string("%.3f", "TAIR"), F.lit("bad")).alias("TAIR"),
        F.format_string("%.3f", "RELH").alias("RELH"),
        F.format_string("%.3f", "PRES").alias("PRES"),
    )
    units = table(spark, folder, "events").where("event_id % 100 = 0").select(
        F.lit("site").alias(SITE), F.lit("").alias(COUNTY), F.lit("Timestamp").alias(TIME), F.lit("degC").alias("TAIR"), F.lit("%").alias("RELH"), F.lit("hPa").alias("PRES")
    )
    path = scratch_path(spark, "export")
    # two files of one folder whose columns stand in another order
    north = F.col("TAIR").endswith("1") | F.col("TAIR").endswith("3")
    sinks.write_table(text.where(north).unionByName(units), f"{path}/north", "csv")
    turned = [COUNTY, "PRES", "RELH", TIME, "TAIR", SITE]
    sinks.write_table(text.where(~north).select(*turned), f"{path}/south", "csv")
    return path


def _scanned(spark, folder):
    back = stations.read_stations(spark, f"{_raw_export(spark, folder)}/*")
    return back.select(SITE, F.col(TIME).cast("timestamp_ntz").alias(TIME), "TAIR", "RELH", "PRES")


CLEANED = ("TAIR", "RELH")


def _cleaning(part):
    """A part of the cleaning job on the raw export."""

    def run(spark, folder):
        raw = stations.read_raw_stations(spark, f"{_raw_export(spark, folder)}/*")
        found = jobs.cleaning_job(raw, stations.type_stations(raw), jobs.STATION, CLEANED)
        if part == "log_summary":
            return found[part]
        return found["complete"].agg(F.lit("complete").alias("part"), F.count("*").alias("n")).unionByName(
            found["incomplete"].agg(F.lit("incomplete").alias("part"), F.count("*").alias("n"))
        ).unionByName(found["chunks"].agg(F.lit("chunk_rows").alias("part"), F.sum("n_rows").alias("n"))).unionByName(
            found["availability"].select(F.concat(F.lit("available "), "variable").alias("part"), F.col("available").alias("n"))
        )

    return run


UNITS = "(SELECT count(*) FROM events WHERE event_id % 100 = 0)"


def _spine(spark, folder, step=3600):
    low, high = table(spark, folder, "events").agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz"), F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")).first()
    return manifest.time_spine(spark, low, high, step)


SPINE_SQL = (
    "s AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS \"timestamp\")"
)
TYPES = ("click", "error", "purchase", "signup", "view")


def _missing_hours(spark, folder):
    expected = manifest.expected_files(_spine(spark, folder), TYPES)
    have = table(spark, folder, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("variable"))
    return manifest.missing_from(expected, have, ["timestamp", "variable"])


def _by_size(spark, folder):
    """Files that are absent or have another size than listed."""
    listed = table(spark, folder, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("length"))
    local = listed.where("name % 9 <> 0").withColumn("length", F.expr("CASE WHEN name % 5 = 0 THEN length - 1 ELSE length END"))
    return manifest.missing_from(listed, local, ["name", "length"])


def _maturity(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        manifest.maturity(F.col("o_orderdate"), F.lit(AS_OF)).alias("label"),
        manifest.maturity_of_year(F.year("o_orderdate"), F.lit(AS_OF)).alias("year_label"),
    )


AGE = "((1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate))"


def _decoded(spark, folder):
    events = table(spark, folder, "events")
    names = F.expr("CASE event_type WHEN 'error' THEN 't2m' WHEN 'click' THEN 'TMP' WHEN 'view' THEN 'rh' ELSE 'other' END")
    grid = events.select("event_id", names.alias("variable"), (F.col("value") + 250).alias("value"))
    return rounded(manifest.convert_grid(grid, ["t2m", "TMP", "rh"]))


def _written_points(spark, folder):
    """Points written by variable and year, read back with a partition filter."""
    orders = table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("timestamp"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'tmean' ELSE 'ppt' END").alias("variable"),
    )
    path = scratch_path(spark, "points")
    sinks.write_points(rows, path)
    back = manifest.choose(spark.read.parquet(path), years=[1996, 1997, 2000])
    return back.groupBy("variable", "year").agg(F.count("*").alias("n"), F.max("value").alias("top"))


def _summary_file(spark, folder):
    """A per-nation summary through the JSON sink."""
    path = scratch_path(spark, "summary")
    sinks.write_summary(points(spark, folder).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top")), path)
    return spark.read.schema("c_nationkey int, n bigint, top double").json(path)


QUERIES: dict[str, Query] = {
    "coerce_numeric": Query(
        lambda s, d: table(s, d, "events").select(
            "event_id",
            number(F.expr("CASE event_type WHEN 'error' THEN props WHEN 'click' THEN 'NaN' WHEN 'view' THEN cast(user_id AS string) ELSE cast(event_id AS string) END")).alias("x"),
        ),
        "SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN NULL WHEN 'view' THEN cast(user_id AS double) ELSE cast(event_id AS double) END AS x FROM events",
    ),
    "parse_times": Query(_times, "SELECT event_id, date_trunc('second', ts) AS t FROM events WHERE event_id % 4 <> 3"),
    "station_export_scan": Query(
        _scanned,
        with_station(f"SELECT {SITE}, date_trunc('second', {TIME}) AS {TIME}, {r('TAIR', 'TAIR', 3)}, {r('RELH', 'RELH', 3)}, {r('PRES', 'PRES', 3)} FROM st"),
    ),
    "cleaning_log": Query(
        _cleaning("log_summary"),
        with_station(" UNION ALL ".join(f"SELECT '{c}' AS \"Column\", count(*) - count({c}) + {UNITS} AS \"Count\" FROM st" for c in CLEANED)),
    ),
    "cleaning_tables": Query(
        _cleaning("tables"),
        with_station(
            "SELECT 'complete' AS part, count(*) FILTER (TAIR IS NOT NULL AND RELH IS NOT NULL) AS n FROM st UNION ALL "
            "SELECT 'incomplete', count(*) FILTER (TAIR IS NULL OR RELH IS NULL) FROM st UNION ALL "
            "SELECT 'chunk_rows', count(*) FILTER (TAIR IS NOT NULL AND RELH IS NOT NULL) FROM st UNION ALL "
            + " UNION ALL ".join(f"SELECT 'available {c}', count({c}) FROM st" for c in CLEANED)
        ),
    ),
    "union_sites": Query(
        lambda s, d: stations.union_sites(
            table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
            table(s, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        ),
        "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier",
    ),
    "preview": Query(
        lambda s, d: stations.preview(table(s, d, "events"), ["ts", "event_id"], 10), "SELECT * FROM events ORDER BY ts, event_id LIMIT 10"
    ),
    "parse_file_names": Query(
        lambda s, d: manifest.parse_names(_files(s, d), "name").select("o_orderkey", "product", "variable", "region", "resolution", "date"),
        f"WITH {FILES_SQL} SELECT o_orderkey, 'grid' AS product, CASE WHEN o_orderkey % 2 = 0 THEN 'tmean' ELSE 'ppt' END AS variable, 'us' AS region, '30s' AS resolution, d AS \"date\" FROM f WHERE name LIKE '%.bil'",
    ),
    "parse_table_names": Query(
        lambda s, d: manifest.parse_names(_files(s, d), "name", r"\.csv$").select("o_orderkey", "variable", "date"),
        f"WITH {FILES_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'tmean' ELSE 'ppt' END AS variable, d AS \"date\" FROM f WHERE name LIKE '%.csv'",
    ),
    "file_name_report": Query(
        lambda s, d: manifest.name_report(_files(s, d), "name"),
        f"WITH {FILES_SQL} SELECT count(*) FILTER (name LIKE '%.bil') AS matched, count(*) FILTER (name NOT LIKE '%.bil') AS skipped FROM f",
    ),
    "available_years": Query(
        lambda s, d: manifest.years_of(_files(s, d)), "SELECT DISTINCT cast(year(o_orderdate) AS int) AS year FROM orders"
    ),
    "choose_files": Query(
        lambda s, d: manifest.choose(_files(s, d).withColumn("year", F.col("y")), [1996, 1998], "_ppt_").select("o_orderkey", "name"),
        f"WITH {FILES_SQL} SELECT o_orderkey, name FROM f WHERE y IN (1996, 1998) AND contains(name, '_ppt_')",
    ),
    "time_spine": Query(_spine, f"WITH {SPINE_SQL} SELECT * FROM s"),
    "missing_hours": Query(
        _missing_hours,
        f"WITH {SPINE_SQL}, v AS (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS variable) SELECT \"timestamp\", variable FROM s, v "
        "EXCEPT SELECT date_trunc('hour', ts), event_type FROM events",
    ),
    "missing_by_size": Query(
        _by_size,
        "SELECT o_orderkey AS name, o_totalprice AS length FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 5 = 0",
    ),
    "data_maturity": Query(
        _maturity,
        f"SELECT o_orderkey, CASE WHEN {AGE} < 1 THEN 'early' WHEN {AGE} < 6 THEN 'provisional' ELSE 'stable' END AS label, "
        "CASE WHEN (1999 - year(o_orderdate)) * 12 + 6 - 12 >= 6 THEN 'stable' ELSE 'provisional' END AS year_label FROM orders",
    ),
    "grid_conversion": Query(
        _decoded,
        f"SELECT event_id, CASE event_type WHEN 'error' THEN 't2m' WHEN 'click' THEN 'TMP' ELSE 'rh' END AS variable, "
        f"{r('CASE WHEN event_type IN (' + repr('error') + ', ' + repr('click') + ') THEN value + 250 - 273.15e0 ELSE value + 250 END', 'value')} "
        "FROM events WHERE event_type IN ('error', 'click', 'view')",
    ),
    "partitioned_sink": Query(
        _written_points,
        "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'tmean' ELSE 'ppt' END AS variable, cast(year(o_orderdate) AS int) AS year, count(*) AS n, max(o_totalprice) AS top "
        "FROM orders WHERE year(o_orderdate) IN (1996, 1997, 2000) GROUP BY ALL",
    ),
    "summary_sink": Query(_summary_file, "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey"),
}
