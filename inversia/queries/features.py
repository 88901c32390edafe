"""Queries on filters, calendar, weather and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from inversia.functions import calendar, weather
from inversia.operators import dummies, filters, live_events, windows
from inversia.plans import jobs
from inversia.queries.views import (
    HOT,
    POINT_SQL,
    SENSORS,
    SITE,
    SPEC,
    TIME,
    Query,
    points,
    r,
    rounded,
    station,
    table,
    with_station,
)
from inversia.plans.series import SeriesSpec
from inversia.session import staged

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
KEYS = (SITE, TIME, "event_id")
KEYS_SQL = ", ".join(KEYS)
STRENGTH = "VT90 - VT05"
PI2 = "6.283185307179586e0"


def _over(site=SITE):
    return f"(PARTITION BY {site} ORDER BY {TIME}, event_id)"


# -- SQL of the row-wise columns -----------------------------------------------------------------
SEASON_SQL = f"CASE WHEN month({TIME}) IN (12, 1, 2) THEN 0 WHEN month({TIME}) <= 5 THEN 1 WHEN month({TIME}) <= 8 THEN 2 ELSE 3 END"
CALENDAR_SQL = {
    "hour": f"cast(hour({TIME}) AS int)",
    "day_of_year": f"cast(dayofyear({TIME}) AS int)",
    "month": f"cast(month({TIME}) AS int)",
    "day_of_week": f"cast(isodow({TIME}) - 1 AS int)",
    "is_weekend": f"cast(isodow({TIME}) >= 6 AS int)",
}
SEASONS_SQL = {
    "season_numeric": SEASON_SQL,
    **{f"season_{n}": f"cast(({SEASON_SQL}) = {i} AS int)" for i, n in enumerate(calendar.SEASONS)},
}
CYCLE_SQL = {
    "hour_sin": f"sin({PI2} * hour({TIME}) / 24)",
    "hour_cos": f"cos({PI2} * hour({TIME}) / 24)",
    "doy_sin": f"sin({PI2} * dayofyear({TIME}) / 365)",
    "doy_cos": f"cos({PI2} * dayofyear({TIME}) / 365)",
}
CODE_SQL = f"CASE WHEN {STRENGTH} <= -2 THEN 0e0 WHEN {STRENGTH} <= 0 THEN 1e0 WHEN {STRENGTH} <= 2 THEN 2e0 WHEN {STRENGTH} <= 5 THEN 3e0 WHEN {STRENGTH} IS NOT NULL THEN 4e0 END"
INVERSION_SQL = {
    "VT_inversion_90_05": STRENGTH,
    "VT_inversion_90_20": "VT90 - VT20",
    "VT_inversion_20_05": "VT20 - VT05",
    "strong_inversion": f"coalesce(cast({STRENGTH} > 0 AS int), 0)",
    "very_strong_inversion": f"coalesce(cast({STRENGTH} > 2 AS int), 0)",
    "inversion_strength_numeric": CODE_SQL,
    **{f"inversion_type_{n}": f"coalesce(cast(({CODE_SQL}) = {i} AS int), 0)" for i, n in enumerate(weather.STRENGTH_CLASSES)},
    "VT_gradient_05_20": "(VT20 - VT05) / 15",
    "VT_gradient_20_90": "(VT90 - VT20) / 70",
    "VT_gradient_05_90": "(VT90 - VT05) / 85",
    "stability_index": "(VT90 - VT05) / 85 * 1000",
    "boundary_layer_strength": "abs(VT90 - VT05)",
    "VT20_VT90_ratio": "VT20 / nullif(VT90, 0)",
    "VT_profile_curvature": "(VT90 - VT20) - (VT20 - VT05)",
}
SURFACE_SQL = {
    "temp_dewpoint_spread": "TAIR - DWPT",
    "wind_u": "-WSPD * sin(radians(WDIR))",
    "wind_v": "-WSPD * cos(radians(WDIR))",
    "is_daylight": "coalesce(cast(SRAD > 10 AS int), 0)",
}
SOIL_SQL = {
    "soil_temp_gradient": "ST04 - ST02",
    "soil_moisture_gradient": "SM04 - SM02",
    "soil_air_temp_diff_02": "ST02 - TAIR",
    "soil_air_temp_diff_04": "ST04 - TAIR",
}
ES_SQL = "6.112e0 * exp(17.67e0 * (CASE WHEN TAIR IS NOT NULL THEN least(greatest(TAIR, -50), 60) END) / ((CASE WHEN TAIR IS NOT NULL THEN least(greatest(TAIR, -50), 60) END) + 243.5e0))"
E_SQL = f"CASE WHEN RELH >= 0 THEN {ES_SQL} * least(greatest(RELH, 0), 100) / 100 END"
PHYSICS_SQL = {
    "potential_temp": "CASE WHEN PRES > 0 THEN TAIR * pow(1000 / PRES, 0.286e0) END",
    "sat_vapor_pressure": ES_SQL,
    "vapor_pressure": E_SQL,
    "virtual_temp_calc": f"CASE WHEN PRES > 0 THEN TAIR * (1 + 0.61e0 * ({E_SQL}) / PRES) END",
}
INTERACTION_SQL = {
    "temp_humidity_interaction": "TAIR * RELH",
    "solar_temp_interaction": "SRAD * TAIR",
    "pressure_temp_interaction": "PRES * TAIR",
    "wind_temp_interaction": "WSPD * (TAIR - 10)",
}
INTEGER = {*CALENDAR_SQL, *SEASONS_SQL, "strong_inversion", "very_strong_inversion", "is_daylight", *[n for n in INVERSION_SQL if n.startswith("inversion_type_")]}


def _shown(columns: dict[str, str], digits=6) -> str:
    return ", ".join(f"{e} AS {n}" if n in INTEGER else r(e, n, digits) for n, e in columns.items())


def _group(sql_columns):
    return with_station(f"SELECT {KEYS_SQL}, {_shown(sql_columns)} FROM st")


def _projected(build):
    def run(spark, folder):
        st = station(spark, folder)
        return rounded(st.select(*KEYS, *[c.alias(n) for n, c in build(st).items()]))

    return run


# -- SQL of the window columns -------------------------------------------------------------------
def _lag_sql(columns, lags, w="w"):
    return {f"{c}_lag_{k}": f"lag({c}, {k}) OVER {w}" for c in columns for k in lags}


def _target_sql(columns, horizons, w="w"):
    return {f"{c}_target_{h}h": f"lead({c}, {h}) OVER {w}" for c in columns for h in horizons}


def _rolling_sql(columns, sizes, w="w"):
    out = {}
    for c in columns:
        for n in sizes:
            frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                out[f"{c}_rolling_{name}_{n}"] = f"CASE WHEN count({c}) OVER {frame} = {n} THEN {agg}({c}) OVER {frame} END"
            out[f"{c}_rolling_change_{n}"] = f"{c} - lag({c}, {n}) OVER {w}"
    return out


def _step(c, k=1):
    return f"{c} - lag({c}, {k}) OVER w"


def _twice(c):
    return f"({c} - lag({c}, 1) OVER w) - (lag({c}, 1) OVER w - lag({c}, 2) OVER w)"


TURN = f"({_step('WDIR')})"
DIFFERENCE_SQL = {
    "temp_change_1h": _step("TAIR"),
    "temp_change_3h": _step("TAIR", 3),
    "temp_acceleration": _twice("TAIR"),
    "pressure_tendency_1h": _step("PRES"),
    "pressure_tendency_3h": f"({_step('PRES', 3)}) / 3",
    "pressure_acceleration": _twice("PRES"),
    "wind_speed_change": _step("WSPD"),
    "wind_direction_change": f"CASE WHEN {TURN} > 180 THEN {TURN} - 360 WHEN {TURN} < -180 THEN {TURN} + 360 ELSE {TURN} END",
    "solar_rad_change": _step("SRAD"),
    "humidity_change": _step("RELH"),
    "soil_temp_change_02": _step("ST02"),
    "soil_temp_change_04": _step("ST04"),
}


def _windowed_sql(columns, site=SITE, base="st", digits=6, keys=KEYS_SQL):
    return f"SELECT {keys}, {_shown(columns, digits)} FROM {base} WINDOW w AS {_over(site)}"


def _events_sql(site, threshold=0.0):
    return with_station(
        f", f AS (SELECT *, {STRENGTH} AS s, sum(CASE WHEN {STRENGTH} > {threshold} THEN 0 ELSE 1 END) OVER {_over(site)} AS run FROM st) "
        f"SELECT {site}, min({TIME}) AS start_time, max({TIME}) AS end_time, count(*) AS n_steps, "
        f"(epoch_us(max({TIME})) - epoch_us(min({TIME}))) / 3600000000.0 AS elapsed_hours, {r('max(s)', 'max_inversion_strength')}, "
        f"{r('avg(s)', 'avg_inversion_strength')}, CASE (CASE WHEN month(min({TIME})) IN (12, 1, 2) THEN 0 WHEN month(min({TIME})) <= 5 THEN 1 "
        f"WHEN month(min({TIME})) <= 8 THEN 2 ELSE 3 END) WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'fall' END AS season "
        f"FROM f WHERE s > {threshold} GROUP BY {site}, run"
    )


def _events(spec, threshold=0.0):
    return lambda s, d: rounded(windows.inversion_events(station(s, d), spec, F.col("VT90") - F.col("VT05"), threshold))


ARRIVALS, LATENESS = 5, 7_200


def _arriving(spark, folder):
    """Rows in five arrivals by time, each row up to two hours late."""
    st = station(spark, folder, ["VT05", "VT90"]).drop("event_type")
    # a row's delay decides with which arrival it comes
    seen = (F.unix_micros(F.col(TIME).cast("timestamp")) / 1e6 + F.col("event_id") % 7200).alias("seen")
    st = staged(st.select("*", seen), "arriving")
    low, high = st.agg(F.min("seen"), F.max("seen")).first()
    width = (high - low) / ARRIVALS
    parts = [st.where((F.col("seen") >= low + i * width) & ((F.col("seen") < low + (i + 1) * width) | F.lit(i == ARRIVALS - 1))) for i in range(ARRIVALS)]
    return rounded(live_events.events_of_arrivals(spark, parts, SPEC, F.col("VT90") - F.col("VT05"), 0.0, LATENESS))


def _dummies(spark, folder):
    """Event types by the vocabulary of the events that are no errors."""
    events = table(spark, folder, "events")
    words = dummies.vocabulary(events.where("event_type <> 'error'"), ["event_type"], 10)
    return dummies.add_dummies(events.select("event_id", "event_type"), words)


VOCABULARY_SQL = (
    "WITH c AS (SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user_id', cast(user_id AS varchar), count(*) FROM events GROUP BY user_id), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM c) "
    "SELECT \"column\", value, cast(place AS int) AS place, n FROM p WHERE place <= 4 "
    "UNION ALL SELECT \"column\", NULL, 5, cast(sum(n) AS bigint) FROM p WHERE place > 4 GROUP BY \"column\""
)


def _build(spark, folder):
    return _rounded_wide(jobs.build_features(station(spark, folder).drop("event_type"), SPEC), 4)


def _rounded_wide(df, digits):
    """As ``rounded``, by whole numbers: Spark's own goes through a decimal text, which for hundreds of
    columns costs more than to make them. Values too large for that are rounded by Spark."""
    scale = f"{10**digits}.0D"

    def shown(c):  # one text a column: hundreds of calls for each would take longer than small tables
        near = f"cast(floor(abs(`{c}`) * {scale} + 0.5D) AS double) / {scale}"
        return F.expr(f"CASE WHEN abs(`{c}`) < 1e11D THEN CASE WHEN `{c}` < 0 THEN 0D - {near} ELSE {near} END + 0D ELSE round(`{c}`, {digits}) END").alias(c)

    real = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[shown(c) if c in real else F.col(c) for c in df.columns])


def _build_sql():
    """The whole feature table; columns outside the station's sensors are skipped as in the job."""
    rowwise = {**CALENDAR_SQL, **SEASONS_SQL, **CYCLE_SQL, **INVERSION_SQL, **SURFACE_SQL, **SOIL_SQL, **PHYSICS_SQL, **INTERACTION_SQL}
    made = ", ".join(f"{e} AS {n}" for n, e in rowwise.items())
    windowed = {
        **DIFFERENCE_SQL,
        **_lag_sql(jobs.CORE, windows.LAGS),
        **_rolling_sql(jobs.CORE, windows.ROLLING),
        **_target_sql(jobs.FORECAST, windows.HORIZONS),
    }
    shown = _shown({**{c: c for c in SENSORS}, **{n: n for n in rowwise}, **windowed}, 4)
    return with_station(f", b AS (SELECT *, {made} FROM st) SELECT {KEYS_SQL}, {shown} FROM b WINDOW w AS {_over()}")


# -- extremes --------------------------------------------------------------------------------------
def _extremes(spark, folder):
    events = table(spark, folder, "events")
    wild = events.select(
        "event_id",
        F.expr("CASE WHEN event_id % 50 = 0 THEN value * 1e31 ELSE value END").alias("a"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN cast('Infinity' AS double) WHEN event_id % 7 = 1 THEN cast('NaN' AS double) ELSE value END").alias("b"),
        F.expr("value * 3e10").alias("c"),
        F.expr("value * 3e10 + 1").alias("d"),
    )
    out = windows.clean_extremes(wild, ["a", "b", "c", "d"], ["c"])
    return out.select("event_id", *[F.round(F.log10(F.col(c) + 1), 6).alias(c) for c in "abcd"])


def _cap(c):
    return f"least(greatest({c}, (SELECT quantile_cont({c}, 0.001) FROM w)), (SELECT quantile_cont({c}, 0.999) FROM w))"


EXTREMES_SQL = (
    "WITH w AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 1e31 ELSE value END AS a, "
    "CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE value END AS b, value * 3e10 AS c, value * 3e10 + 1 AS d FROM events) "
    f"SELECT event_id, round(log10({_cap('a')} + 1), 6) AS a, round(log10(b + 1), 6) AS b, round(log10({_cap('c')} + 1), 6) AS c, round(log10(d + 1), 6) AS d FROM w"
)


# -- features chosen for a model -------------------------------------------------------------------
def _selected(spark, folder):
    st = windows.add_targets(station(spark, folder), SPEC, ["VT20"], [1]).withColumn("season_name", F.lit("winter"))
    chosen = filters.select_features(st, ids=(*filters.ID_COLUMNS, "event_id"))
    shares = st.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in chosen])
    return rounded(shares.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in chosen]))))


SELECTED_SQL = with_station(
    ", st2 AS (SELECT *, 'winter' AS season_name FROM st), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM st2" for c in [*SENSORS, "season_name"])
    + f") SELECT feature, {r('missing', 'missing')} FROM m WHERE missing < 0.5"
)

QUERIES: dict[str, Query] = {
    "drop_columns": Query(
        lambda s, d: rounded(filters.drop_columns(station(s, d, ["TAIR", "ST02", "SM02"]), ["ST02", "SM02", "ST04"])),
        with_station(f"SELECT {KEYS_SQL}, event_type, {r('TAIR', 'TAIR')} FROM st"),
    ),
    "complete_rows": Query(
        lambda s, d: rounded(filters.complete_rows(station(s, d, ["TAIR", "RELH"]), ["TAIR", "RELH"])),
        with_station(f"SELECT {KEYS_SQL}, event_type, {r('TAIR', 'TAIR')}, {r('RELH', 'RELH')} FROM st WHERE TAIR IS NOT NULL AND RELH IS NOT NULL"),
    ),
    "incomplete_rows": Query(
        lambda s, d: rounded(filters.incomplete_rows(station(s, d, ["TAIR", "RELH"]), ["TAIR", "RELH"])),
        with_station(f"SELECT {KEYS_SQL}, event_type, {r('TAIR', 'TAIR')}, {r('RELH', 'RELH')} FROM st WHERE TAIR IS NULL OR RELH IS NULL"),
    ),
    "region_points": Query(
        lambda s, d: rounded(filters.in_region(points(s, d))),
        f"SELECT c_custkey, c_nationkey, {r('c_acctbal', 'c_acctbal')}, {r('latitude', 'latitude')}, {r('longitude', 'longitude')} FROM ({POINT_SQL}) "
        "WHERE longitude BETWEEN -89.813 AND -81.688 AND latitude BETWEEN 36.188 AND 39.438",
    ),
    "site_rows": Query(
        lambda s, d: rounded(filters.site_rows(station(s, d, ["TAIR"]), SITE, "7")),
        with_station(f"SELECT {KEYS_SQL}, event_type, {r('TAIR', 'TAIR')} FROM st WHERE {SITE} = '7'"),
    ),
    "large_sites": Query(
        lambda s, d: filters.large_sites(station(s, d, []), [SITE], 66),
        with_station(f"SELECT {KEYS_SQL}, event_type FROM st WHERE {SITE} IN (SELECT {SITE} FROM st GROUP BY {SITE} HAVING count(*) > 66)"),
    ),
    "inversion_rows": Query(
        lambda s, d: filters.inversion_rows(
            (lambda st: st.select(*KEYS, *[c.alias(n) for n, c in weather.inversion_columns(st.columns).items() if n == "strong_inversion"]))(station(s, d))
        ),
        with_station(f"SELECT {KEYS_SQL}, 1 AS strong_inversion FROM st WHERE VT90 - VT05 > 0"),
    ),
    "drop_outliers_by_site": Query(
        lambda s, d: filters.drop_outliers(table(s, d, "events"), "value", ["event_type"]).select("event_id", "event_type", "value"),
        "SELECT event_id, e.event_type, value FROM events e JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type) s "
        "ON e.event_type = s.event_type WHERE abs((value - m) / sd) < 3",
    ),
    "drop_outliers": Query(
        lambda s, d: filters.drop_outliers(table(s, d, "events"), "value").select("event_id", "value"),
        "SELECT event_id, value FROM events WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)) < 3",
    ),
    "point_columns": Query(
        lambda s, d: rounded(
            filters.point_columns(
                points(s, d).withColumns({"tmean": F.col("c_acctbal"), "timestamp": F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")}).drop("c_acctbal"),
                SeriesSpec(("c_nationkey",), "c_custkey"),
            )
        ),
        "SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS key, 0.0e0 AS altitude, 0.0e0 AS dist, 0.0e0 AS hr, "
        f"{r('latitude', 'latitude')}, {r('longitude', 'longitude')}, c_acctbal AS tmean, TIMESTAMP '2021-01-01 00:00:00' AS \"timestamp\" FROM ({POINT_SQL})",
    ),
    "select_features": Query(_selected, SELECTED_SQL),
    "numeric_only": Query(
        lambda s, d: filters.numeric_only(table(s, d, "events"), ["ts"]), "SELECT event_id, ts, user_id, value FROM events"
    ),
    "coerce_leftovers": Query(
        lambda s, d: filters.coerce_leftovers(
            table(s, d, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.col("user_id").cast("string")).alias("x")), []
        ),
        "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE cast(user_id AS double) END AS x FROM events",
    ),
    "difference_targets": Query(
        lambda s, d: rounded(filters.difference_targets(station(s, d, ["TAIR", "VT20", "VT90"])).select(*KEYS, "TAIR_VT20", "VT90_VT20")),
        with_station(f"SELECT {KEYS_SQL}, {r('TAIR - VT20', 'TAIR_VT20')}, {r('VT90 - VT20', 'VT90_VT20')} FROM st WHERE TAIR IS NOT NULL"),
    ),
    "calendar_parts": Query(_projected(lambda st: calendar.calendar_parts(F.col(TIME))), _group(CALENDAR_SQL)),
    "seasons": Query(
        lambda s, d: table(s, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in calendar.season_columns(F.col("o_orderdate")).items()], calendar.season_name(F.month("o_orderdate")).alias("season")),
        "SELECT o_orderkey, " + ", ".join(f"{e.replace(TIME, 'o_orderdate')} AS {n}" for n, e in SEASONS_SQL.items())
        + f", CASE ({SEASON_SQL.replace(TIME, 'o_orderdate')}) WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'fall' END AS season FROM orders",
    ),
    "cyclic_time": Query(_projected(lambda st: calendar.cyclic_columns(F.col(TIME))), _group(CYCLE_SQL)),
    "model_time": Query(
        _projected(lambda st: calendar.model_time_columns(st, TIME)),
        with_station(
            f"SELECT {KEYS_SQL}, cast(floor(epoch_us({TIME}) / 1000000) AS bigint) AS timestamp_float, cast(hour({TIME}) AS int) AS hour, "
            f"cast(dayofyear({TIME}) AS int) AS day_of_year, cast(month({TIME}) AS int) AS month, cast(hour({TIME}) BETWEEN 6 AND 18 AS int) AS is_daytime FROM st"
        ),
    ),
    "inversion_features": Query(_projected(lambda st: weather.inversion_columns(st.columns)), _group(INVERSION_SQL)),
    "surface_features": Query(_projected(lambda st: weather.surface_columns(st.columns)), _group(SURFACE_SQL)),
    "soil_features": Query(_projected(lambda st: weather.soil_columns(st.columns)), _group(SOIL_SQL)),
    "physics_features": Query(_projected(lambda st: weather.physics_columns(st.columns)), _group(PHYSICS_SQL)),
    "interaction_features": Query(_projected(lambda st: weather.interaction_columns(st.columns)), _group(INTERACTION_SQL)),
    "clean_extremes": Query(_extremes, EXTREMES_SQL),
    "lags": Query(
        lambda s, d: rounded(windows.add_lags(station(s, d, ["TAIR", "VT90"]), SPEC, ["TAIR", "VT90"]).drop("TAIR", "VT90", "event_type")),
        with_station(_windowed_sql(_lag_sql(["TAIR", "VT90"], windows.LAGS))),
    ),
    "forecast_targets": Query(
        lambda s, d: rounded(windows.add_targets(station(s, d, ["VT20", "VT90"]), SPEC, ["VT20", "VT90"]).drop("VT20", "VT90", "event_type")),
        with_station(_windowed_sql(_target_sql(["VT20", "VT90"], windows.HORIZONS))),
    ),
    "rolling": Query(
        lambda s, d: rounded(windows.add_rolling(station(s, d, ["TAIR", "PRES"]), SPEC, ["TAIR", "PRES"]).drop("TAIR", "PRES", "event_type")),
        with_station(_windowed_sql(_rolling_sql(["TAIR", "PRES"], windows.ROLLING))),
    ),
    "rolling_long_series": Query(
        lambda s, d: rounded(windows.add_rolling(station(s, d, ["TAIR"]), HOT, ["TAIR"]).drop("TAIR", SITE)),
        with_station(_windowed_sql(_rolling_sql(["TAIR"], windows.ROLLING), "event_type", keys=f"event_type, {TIME}, event_id")),
    ),
    "differences": Query(
        lambda s, d: rounded((lambda st: windows.add_differences(st, SPEC).drop(*SENSORS, "event_type"))(station(s, d))),
        with_station(_windowed_sql(DIFFERENCE_SQL)),
    ),
    "inversion_events": Query(_events(SPEC), _events_sql(SITE)),
    "inversion_events_threshold": Query(_events(SPEC, 1.5), _events_sql(SITE, 1.5)),
    "inversion_events_long_series": Query(_events(HOT), _events_sql("event_type")),
    "events_incremental": Query(_arriving, _events_sql(SITE)),
    "site_dummies": Query(
        _dummies,
        "SELECT event_id, event_type, " + ", ".join(f"cast(event_type = '{v}' AS int) AS event_type_{v}" for v in EVENT_TYPES if v != "error") + ", cast(event_type = 'error' AS int) AS event_type_other FROM events",
    ),
    "dummy_vocabulary": Query(
        lambda s, d: dummies.vocabulary(table(s, d, "events"), ["event_type", "user_id"], 4), VOCABULARY_SQL
    ),
    "event_summary": Query(
        lambda s, d: rounded(windows.event_summary(station(s, d), SPEC, F.col("VT90") - F.col("VT05"))),
        with_station(
            f", f AS (SELECT *, {STRENGTH} AS s, sum(CASE WHEN {STRENGTH} > 0 THEN 0 ELSE 1 END) OVER {_over()} AS run FROM st) "
            f"SELECT {SITE}, count(*) AS steps, count(*) FILTER (s > 0) AS inversion_steps, {r('count(*) FILTER (s > 0) * 100.0 / count(*)', 'inversion_pct')}, "
            f"count(DISTINCT CASE WHEN s > 0 THEN run END) AS events, {r('max(s) FILTER (s > 0)', 'strongest')}, {r('avg(s) FILTER (s > 0)', 'average_strength')} "
            f"FROM f GROUP BY {SITE}"
        ),
    ),
    "feature_build": Query(_build, _build_sql()),
}

