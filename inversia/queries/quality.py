"""Queries on missing values, gaps, periods and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from inversia.operators import filters, impute, quality
from inversia.plans import jobs
from inversia.plans.series import SeriesSpec
from inversia.queries.views import HOT, SITE, SPEC, TIME, Query, r, rounded, station, table, with_station

VARS = ("TAIR", "RELH", "WDIR")
HOURS = 3600.0


def _counts_sql(columns, by=""):
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}count(*) AS total, '{c}' AS variable, count(*) - count({c}) AS missing FROM st{group}" for c in columns
    )


def _runs_sql(columns, site):
    return " UNION ALL ".join(
        f"SELECT {site}, '{c}' AS variable, min({TIME}) AS gap_start, max({TIME}) AS gap_end, count(*) AS gap_length FROM "
        f"(SELECT *, count({c}) OVER (PARTITION BY {site} ORDER BY {TIME}, event_id) AS run FROM st) WHERE {c} IS NULL GROUP BY {site}, run"
        for c in columns
    )


def _analysis_sql(columns, site):
    return with_station(
        f", c AS ({_counts_sql(columns, site)}), g AS ({_runs_sql(columns, site)}), "
        f"a AS (SELECT {site}, variable, count(*) AS n, max(gap_length) AS m, avg(gap_length) AS v FROM g GROUP BY ALL) "
        f"SELECT c.{site}, c.variable, missing AS total_missing, {r('missing * 100.0 / total', 'missing_percentage')}, "
        f"coalesce(n, 0) AS number_of_gaps, coalesce(m, 0) AS max_gap_length, {r('coalesce(v, 0.0)', 'avg_gap_length')} "
        f"FROM c LEFT JOIN a ON c.{site} = a.{site} AND c.variable = a.variable"
    )


def _raw(spark, folder):
    """Three text sensors with text that is no number, and nulls."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").cast("string").alias(SITE),
        F.col("ts").alias(TIME),
        "event_id",
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("user_id").cast("string")).alias("RAW1"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("RAW2"),
    )


RAW_SQL = (
    f"WITH raw AS (SELECT cast(user_id AS string) AS {SITE}, ts AS {TIME}, event_id, "
    "CASE WHEN event_type = 'error' THEN props ELSE cast(user_id AS string) END AS RAW1, "
    "CASE WHEN event_type <> 'click' THEN event_type END AS RAW2, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) "
)
LOG_SQL = " UNION ALL ".join(
    f"SELECT {SITE}, {TIME} AS DateTime, n AS Row_Index, '{c}' AS \"Column\", {c} AS Original_Value, "
    f"CASE WHEN {c} IS NULL THEN 'Already_missing' ELSE 'Non-numeric_converted' END AS Missing_Type "
    f"FROM raw WHERE try_cast({c} AS double) IS NULL"
    for c in ("RAW1", "RAW2")
)

# Time gaps: events of one user come hours apart, so "expected" is 8 h with 1 h tolerance.
GAP = {"expected_s": 8 * HOURS, "tolerance_s": HOURS}


def _steps_sql(site):
    return (
        f"d AS (SELECT {site}, {TIME}, event_id, lag({TIME}) OVER w AS prev, "
        f"(epoch_us({TIME}) - epoch_us(lag({TIME}) OVER w)) / 1000000.0 AS step FROM st "
        f"WINDOW w AS (PARTITION BY {site} ORDER BY {TIME}, event_id)), "
        f"n AS (SELECT *, sum(CASE WHEN step > 32400 THEN 1 ELSE 0 END) OVER (PARTITION BY {site} ORDER BY {TIME}, event_id) AS g FROM d), "
        f"p AS (SELECT {site}, g + 1 AS period, min({TIME}) AS start_date, max({TIME}) AS end_date, "
        f"epoch_us(max({TIME})) - epoch_us(min({TIME})) AS us, count(*) AS record_count FROM n GROUP BY {site}, g)"
    )


def _gaps_sql(site):
    return with_station(
        f", {_steps_sql(site)} SELECT {site}, cast(g AS bigint) AS gap, prev AS gap_start, {TIME} AS gap_end, {r('step', 'gap_seconds')}, "
        "cast(floor(step / 28800.0) - 1 AS bigint) AS missing_records_est FROM n WHERE step > 32400"
    )


def _periods_sql(site):
    return with_station(
        f", {_steps_sql(site)} SELECT {site}, cast(period AS bigint) AS period, start_date, end_date, us / 3600000000.0 AS duration_hours, record_count FROM p"
    )


def _completeness_sql(site):
    return with_station(
        f", {_steps_sql(site)}, t AS (SELECT {site}, count(*) AS periods, epoch_us(max(end_date)) - epoch_us(min(start_date)) AS span, "
        f"sum(us) AS data, first(us ORDER BY us DESC, start_date) AS lus, first(start_date ORDER BY us DESC, start_date) AS longest_start, "
        f"first(end_date ORDER BY us DESC, start_date) AS longest_end FROM p GROUP BY {site}) "
        f"SELECT {site}, periods, span / 3600000000.0 AS span_hours, data / 3600000000.0 AS data_hours, "
        f"(span - data) / 3600000000.0 AS gap_hours, {r('data * 100.0 / nullif(span, 0)', 'completeness_pct')}, "
        f"lus / 3600000000.0 AS longest_hours, longest_start, longest_end FROM t"
    )


def _complete(columns=VARS):
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _chunks_cte(site):
    ok = f"CASE WHEN {_complete()} THEN 1 ELSE 0 END"
    w = f"(PARTITION BY {site} ORDER BY {TIME}, event_id)"
    return (
        f"k AS (SELECT {site}, {TIME}, {ok} AS ok, row_number() OVER {w} - 1 AS n, sum({ok}) OVER {w} AS good, "
        f"sum(1 - {ok}) OVER {w} AS bad, sum({ok}) OVER (PARTITION BY {site}) AS every FROM st)"
    )


EXTENT_SQL = (
    f"min(n) AS start_row, max(n) AS end_row, min({TIME}) AS start_time, max({TIME}) AS end_time, count(*) AS n_rows, "
    f"(epoch_us(max({TIME})) - epoch_us(min({TIME}))) / 3600000000.0 AS span_hours"
)


def _chunks_sql(site):
    return with_station(f", {_chunks_cte(site)} SELECT {site}, {EXTENT_SQL} FROM k WHERE ok = 1 GROUP BY {site}, bad")


def _chunk_gaps_sql(site):
    return with_station(
        f", {_chunks_cte(site)} SELECT {site}, {EXTENT_SQL} FROM k WHERE ok = 0 AND good > 0 AND good < every GROUP BY {site}, good"
    )


def _cell_diff(spark, folder):
    st = station(spark, folder, ["TAIR", "RELH", "WSPD"])
    other = st.where(F.col("event_type") != "signup").withColumns(
        {"TAIR": F.coalesce("TAIR", F.lit(0.0)), "RELH": F.when(F.col("event_type") != "view", F.col("RELH"))}
    )
    return quality.cell_diff(st, other, [SITE, TIME, "event_id"], ["TAIR", "RELH", "WSPD"])


def _compare(spark, folder):
    a = station(spark, folder, ["TAIR", "RELH", "WSPD", "PRES"])
    b = a.where(F.col("event_type") != "signup").select(
        SITE, TIME, "event_id", F.coalesce("TAIR", F.lit(1.0)).alias("TAIR"), (F.col("RELH") * 1.5).alias("RELH"), (F.col("WSPD") + 0.25).alias("WSPD")
    )
    return rounded(quality.compare_columns(a, b, [SITE, TIME, "event_id"]))


def _fill_report(spark, folder):
    st = station(spark, folder, VARS)
    filled = impute.forward_backward_fill(st, SPEC, ["TAIR", "RELH"], 1)
    return rounded(quality.fill_report(st, filled, VARS))


def _ffill_one(c):
    w = f"(PARTITION BY {SITE} ORDER BY {TIME}, event_id)"
    return f"coalesce({c}, lag({c}) OVER {w})"


FILL_REPORT_SQL = with_station(
    ", a AS (SELECT *, " + ", ".join(f"{_ffill_one(c)} AS f_{c}" for c in ("TAIR", "RELH")) + " FROM st), "
    "b AS (SELECT *, "
    + ", ".join(f"coalesce(f_{c}, lead(f_{c}) OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id)) AS g_{c}" for c in ("TAIR", "RELH"))
    + ", WDIR AS g_WDIR FROM a) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS original_missing, {r(f'(count(*) - count({c})) * 100.0 / count(*)', 'original_pct')}, "
        f"count(*) - count(g_{c}) AS current_missing, {r(f'(count(*) - count(g_{c})) * 100.0 / count(*)', 'current_pct')}, "
        f"count(g_{c}) - count({c}) AS filled FROM b"
        for c in VARS
    )
)

def _continuity(spark, folder):
    """Periods, gaps and completeness of the continuity report, counted per site."""
    found = jobs.continuity_report(station(spark, folder, ["TAIR"]), SPEC, **GAP)
    periods = found["periods"].groupBy(SITE).agg(F.count("*").alias("periods"), F.sum("record_count").alias("records"))
    gaps = found["gaps"].groupBy(SITE).agg(F.count("*").alias("gaps"))
    complete = found["completeness"].select(SITE, F.col("periods").alias("reported_periods"))
    return periods.join(gaps, SITE, "left").join(complete, SITE).withColumn("gaps", F.coalesce("gaps", F.lit(0)))


CONTINUITY_SQL = with_station(
    f", {_steps_sql(SITE)} SELECT {SITE}, count(*) AS periods, cast(sum(record_count) AS bigint) AS records, count(*) - 1 AS gaps, count(*) AS reported_periods "
    f"FROM p GROUP BY {SITE}"
)

QUERIES: dict[str, Query] = {
    "continuity": Query(_continuity, CONTINUITY_SQL),
    "missing_map": Query(
        lambda s, d: quality.missing_map(station(s, d), [SITE, TIME, "event_id"], VARS),
        with_station(f"SELECT {SITE}, {TIME}, event_id, " + ", ".join(f"({c} IS NULL)::int AS {c}" for c in VARS) + " FROM st"),
    ),
    "missing_by_column": Query(
        lambda s, d: rounded(quality.missing_by_column(station(s, d), [*VARS, "VR05", "PRES"])),
        with_station(f", c AS ({_counts_sql([*VARS, 'VR05', 'PRES'])}) SELECT *, {r('missing * 100.0 / total', 'missing_pct')} FROM c"),
    ),
    "missing_totals": Query(
        lambda s, d: rounded(quality.missing_totals(station(s, d), [*VARS, "VR05", "PRES"])),
        with_station(
            f", c AS ({_counts_sql([*VARS, 'VR05', 'PRES'])}) SELECT cast(sum(total) AS bigint) AS cells, cast(sum(missing) AS bigint) AS missing, "
            f"{r('sum(missing) * 100.0 / sum(total)', 'missing_pct')} FROM c"
        ),
    ),
    "missing_log": Query(lambda s, d: quality.missing_log(_raw(s, d), SPEC, ["RAW1", "RAW2"]), RAW_SQL + LOG_SQL),
    "missing_log_summary": Query(
        lambda s, d: quality.missing_log_summary(quality.missing_log(_raw(s, d), SPEC, ["RAW1", "RAW2"])),
        RAW_SQL + f'SELECT "Column", count(*) AS "Count" FROM ({LOG_SQL}) GROUP BY "Column"',
    ),
    "first_raw_values": Query(
        lambda s, d: quality.first_raw_values(_raw(s, d), SPEC, ["RAW1", "RAW2"], 20),
        RAW_SQL
        + 'SELECT * FROM (SELECT "Column", "Value", row_number() OVER (PARTITION BY "Column" ORDER BY t, e, "Value") AS Seen_No FROM ('
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"Column\", coalesce({c}, 'nan') AS \"Value\", min({TIME}) AS t, arg_min(event_id, ({TIME}, event_id)) AS e FROM raw GROUP BY ALL"
            for c in ("RAW1", "RAW2")
        )
        + ")) WHERE Seen_No <= 20",
    ),
    "missing_runs": Query(lambda s, d: quality.missing_runs(station(s, d), SPEC, VARS), with_station(f"SELECT * FROM ({_runs_sql(VARS, SITE)})")),
    "gap_analysis": Query(lambda s, d: rounded(quality.gap_analysis(station(s, d), SPEC, [*VARS, "PRES"])), _analysis_sql([*VARS, "PRES"], SITE)),
    "gap_analysis_long_series": Query(
        lambda s, d: rounded(quality.gap_analysis(station(s, d).drop(SITE).withColumn("event_type", F.lit("all")), HOT, VARS)),
        _analysis_sql(VARS, "event_type").replace("event_id, event_type,", "event_id, 'all' AS event_type,", 1),
    ),
    "time_gaps": Query(lambda s, d: rounded(quality.time_gaps(station(s, d), SPEC, **GAP)), _gaps_sql(SITE)),
    "continuous_periods": Query(lambda s, d: rounded(quality.continuous_periods(station(s, d), SPEC, **GAP)), _periods_sql(SITE)),
    "completeness_report": Query(lambda s, d: rounded(quality.completeness(station(s, d), SPEC, **GAP)), _completeness_sql(SITE)),
    "complete_chunks": Query(lambda s, d: rounded(quality.complete_chunks(station(s, d), SPEC, VARS)), _chunks_sql(SITE)),
    "complete_chunks_long_series": Query(
        lambda s, d: rounded(quality.complete_chunks(station(s, d).withColumn("event_type", F.lit("all")), HOT, VARS)),
        _chunks_sql("event_type").replace("event_id, event_type,", "event_id, 'all' AS event_type,", 1),
    ),
    "chunk_gaps": Query(lambda s, d: rounded(quality.chunk_gaps(station(s, d), SPEC, VARS)), _chunk_gaps_sql(SITE)),
    "chunk_summary": Query(
        lambda s, d: rounded(quality.chunk_summary(station(s, d), SPEC, VARS)),
        with_station(
            f", {_chunks_cte(SITE)}, c AS (SELECT {SITE}, count(DISTINCT bad) AS chunks FROM k WHERE ok = 1 GROUP BY {SITE}) "
            f"SELECT k.{SITE}, count(*) AS total_rows, cast(sum(ok) AS bigint) AS complete_rows, {r('sum(ok) * 100.0 / count(*)', 'complete_pct')}, "
            f"coalesce(any_value(chunks), 0) AS chunks FROM k LEFT JOIN c ON k.{SITE} = c.{SITE} GROUP BY k.{SITE}"
        ),
    ),
    "availability": Query(
        lambda s, d: quality.availability(station(s, d), TIME, [*VARS, "VR05"], [SITE]),
        with_station(
            " UNION ALL ".join(
                f"SELECT {SITE}, '{c}' AS variable, min({TIME}) FILTER ({c} IS NOT NULL) AS first_time, max({TIME}) FILTER ({c} IS NOT NULL) AS last_time, "
                f"count({c}) AS available FROM st GROUP BY {SITE}"
                for c in [*VARS, "VR05"]
            )
        ),
    ),
    "cell_diff": Query(
        _cell_diff,
        with_station(
            f", o AS (SELECT {SITE}, {TIME}, event_id, coalesce(TAIR, 0.0) AS TAIR, CASE WHEN event_type <> 'view' THEN RELH END AS RELH, WSPD FROM st WHERE event_type <> 'signup'), "
            f"b AS (SELECT coalesce(st.{SITE}, o.{SITE}) AS {SITE}, coalesce(st.{TIME}, o.{TIME}) AS {TIME}, coalesce(st.event_id, o.event_id) AS event_id, "
            "st.TAIR AS a1, o.TAIR AS b1, st.RELH AS a2, o.RELH AS b2, st.WSPD AS a3, o.WSPD AS b3 FROM st FULL JOIN o ON st.event_id = o.event_id) "
            + " UNION ALL ".join(
                f"SELECT {SITE}, {TIME}, event_id, '{c}' AS variable, a{i} AS self, b{i} AS other FROM b WHERE a{i} IS DISTINCT FROM b{i}"
                for i, c in ((1, "TAIR"), (2, "RELH"), (3, "WSPD"))
            )
        ),
    ),
    "compare_columns": Query(
        _compare,
        with_station(
            ", o AS (SELECT event_id, TAIR - coalesce(TAIR, 1.0) AS TAIR, RELH - RELH * 1.5 AS RELH, WSPD - (WSPD + 0.25) AS WSPD FROM st WHERE event_type <> 'signup') "
            + " UNION ALL ".join(
                f"SELECT '{c}' AS variable, count({c}) AS pairs, {r(f'avg({c})', 'mean_diff')}, {r(f'stddev_samp({c})', 'std_diff')}, "
                f"{r(f'max(abs({c}))', 'max_abs_diff')} FROM o"
                for c in ("TAIR", "RELH", "WSPD")
            )
        ),
    ),
    "fill_report": Query(_fill_report, FILL_REPORT_SQL),
    "dataset_profile": Query(
        lambda s, d: rounded(quality.dataset_profile(filters.difference_targets(station(s, d)), SITE, TIME, ["TAIR_VT20", "VT90_VT20"])),
        with_station(
            ", t AS (SELECT *, TAIR - VT20 AS TAIR_VT20, VT90 - VT20 AS VT90_VT20 FROM st WHERE TAIR IS NOT NULL) "
            + " UNION ALL ".join(
                f'SELECT count(*) AS total_records, count(DISTINCT {SITE}) AS sites, min({TIME}) AS "start", max({TIME}) AS "end", \'{c}\' AS target, '
                f'{r(f"avg({c})", "mean")}, {r(f"stddev_samp({c})", "std")}, {r(f"min({c})", "min")}, {r(f"max({c})", "max")} FROM t'
                for c in ("TAIR_VT20", "VT90_VT20")
            )
        ),
    ),
    "subset_coverage": Query(
        lambda s, d: quality.coverage(filters.complete_rows(station(s, d), VARS), TIME, [SITE]),
        with_station(f"SELECT {SITE}, min({TIME}) AS first_time, max({TIME}) AS last_time, count(*) AS n_rows FROM st WHERE {_complete()} GROUP BY {SITE}"),
    ),
}
