"""Queries on gap filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.operators import impute, impute_ml
from inversia.plans import jobs
from inversia.queries.views import HOT, SITE, SPEC, TIME, Query, r, rounded, station, with_station
from inversia.session import scratch_path, staged

KEYS = f"{SITE}, {TIME}, event_id"


def _linear_cte(columns: dict[str, str], limit: int, site: str, base: str = "st") -> str:
    """Neighbours and positions of every column, then the bounded two-sided linear fill."""
    order = f"PARTITION BY {site} ORDER BY {TIME}, event_id"
    known = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER up AS {n}_p, first_value({c} IGNORE NULLS) OVER down AS {n}_q, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER up AS {n}_i, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN n END IGNORE NULLS) OVER down AS {n}_j, {c} AS {n}_v"
        for n, c in columns.items()
    )
    filled = ", ".join(
        f"CASE WHEN {n}_v IS NOT NULL THEN {n}_v WHEN {n}_p IS NOT NULL AND {n}_q IS NOT NULL THEN "
        f"CASE WHEN n - {n}_i <= {limit} OR {n}_j - n <= {limit} THEN {n}_p + ({n}_q - {n}_p) * (n - {n}_i) / ({n}_j - {n}_i) END "
        f"WHEN {n}_q IS NULL THEN CASE WHEN n - {n}_i <= {limit} THEN {n}_p END ELSE CASE WHEN {n}_j - n <= {limit} THEN {n}_q END END AS {n}"
        for n in columns
    )
    return (
        f"x1 AS (SELECT *, row_number() OVER ({order}) AS n FROM {base}), "
        f"x2 AS (SELECT *, {known} FROM x1 WINDOW up AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"down AS ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
        f"x3 AS (SELECT {site} AS s0, {TIME} AS t0, event_id AS e0, {filled} FROM x2)"
    )


def _linear_sql(columns, limit, site=SITE):
    shown = ", ".join(r(f"f_{c}", c) for c in columns)
    return with_station(f", {_linear_cte({f'f_{c}': c for c in columns}, limit, site)} SELECT s0 AS {site}, t0 AS {TIME}, e0 AS event_id, {shown} FROM x3")


def _circle(df):
    """Compare directions on the circle."""
    return rounded(df.select(SITE, TIME, "event_id", F.sin(F.radians("WDIR")).alias("s"), F.cos(F.radians("WDIR")).alias("c")), 5)


CIRCLE_SQL = with_station(
    ", "
    + _linear_cte({"f_c": "cos(radians(WDIR))", "f_s": "sin(radians(WDIR))"}, 2, SITE)
    + f" SELECT s0 AS {SITE}, t0 AS {TIME}, e0 AS event_id, {r('f_s / sqrt(f_s * f_s + f_c * f_c)', 's', 5)}, {r('f_c / sqrt(f_s * f_s + f_c * f_c)', 'c', 5)} FROM x3"
)


def _both_ways_sql(columns, rain, limit):
    order = f"PARTITION BY {SITE} ORDER BY {TIME}, event_id"
    every = [*columns, *rain]
    return with_station(
        ", a AS (SELECT *, "
        + ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS f_{c}" for c in every)
        + f" FROM st WINDOW b AS ({order} ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)) SELECT {KEYS}, "
        + ", ".join([r(f"first_value(f_{c} IGNORE NULLS) OVER d", c) for c in columns] + [r(f"f_{c}", c) for c in rain])
        + f" FROM a WINDOW d AS ({order} ROWS BETWEEN CURRENT ROW AND {limit} FOLLOWING)"
    )


def _fill_all_sql(columns):
    order = f"PARTITION BY {SITE} ORDER BY {TIME}, event_id"
    return with_station(
        f"SELECT {KEYS}, "
        + ", ".join(r(f"coalesce(last_value({c} IGNORE NULLS) OVER up, first_value({c} IGNORE NULLS) OVER down)", c) for c in columns)
        + f" FROM st WINDOW up AS ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


def _some(spark, folder, *columns):
    return station(spark, folder, columns).drop("event_type")


# A fixed arithmetic mask, so that the check can hide the same cells.
HIDDEN = "event_id % 10 = 3"


def _evaluation(spark, folder):
    st = _some(spark, folder, "TAIR")
    return rounded(impute_ml.evaluate_fill(st, SPEC, "TAIR", method="linear", hidden=F.expr(HIDDEN)))


EVALUATION_SQL = with_station(
    f", h AS (SELECT *, CASE WHEN {HIDDEN} THEN TAIR END AS truth, CASE WHEN NOT ({HIDDEN}) THEN TAIR END AS v FROM st), "
    + _linear_cte({"f": "v"}, 12, SITE, "h")
    + ", j AS (SELECT truth AS y, f AS p FROM x3 JOIN h ON h.event_id = x3.e0 WHERE truth IS NOT NULL) "
    "SELECT 'TAIR' AS variable, count(*) AS n_test_points, count(p) AS n_filled, "
    + ", ".join(
        [
            r("avg(abs(y - p))", "mae"),
            r("sqrt(avg((y - p) * (y - p)))", "rmse"),
            r("1 - sum((y - p) * (y - p)) / (count(p) * var_pop(CASE WHEN p IS NOT NULL THEN y END))", "r2"),
        ]
    )
    + " FROM j"
)

SMALL = impute_ml.FillModels(trees=20, tree_depth=6, rounds=5)


def _facts(before, after, variable, method):
    """Known cells left as they were, cells filled, cells left empty."""
    both = before.select("event_id", F.col(variable).alias("a")).join(after.select("event_id", F.col(variable).alias("b")), "event_id")
    return both.agg(
        F.lit(variable).alias("variable"),
        F.lit(method).alias("method"),
        F.count(F.when(F.col("a") == F.col("b"), 1)).alias("unchanged"),
        F.count(F.when(F.col("a") != F.col("b"), 1)).alias("changed"),
        F.count(F.when(F.col("a").isNull() & F.col("b").isNotNull(), 1)).alias("filled"),
        F.count(F.when(F.col("a").isNull() & F.col("b").isNull(), 1)).alias("still_missing"),
    )


def _facts_sql(variable, method, left="0"):
    return (
        f"SELECT '{variable}' AS variable, {method} AS method, count({variable}) AS unchanged, 0 AS changed, "
        f"cast(count(*) - count({variable}) - ({left}) AS bigint) AS filled, cast({left} AS bigint) AS still_missing FROM st"
    )


def _hidden(st):
    """Every seventh known cell hidden, its value kept beside it."""
    hide = F.col("TAIR").isNotNull() & (F.col("event_id") % 7 == 0)
    return st.withColumns({"truth": F.when(hide, F.col("TAIR")), "TAIR": F.when(~hide, F.col("TAIR"))})


def _beats_mean(masked, filled):
    """Whether hidden cells come back at less than half the squared error of the mean."""
    mean = masked.agg(F.avg("TAIR")).first()[0]
    back = filled.where("truth IS NOT NULL AND TAIR IS NOT NULL")
    return back.agg(F.sum((F.col("truth") - F.col("TAIR")) ** 2) < 0.5 * F.sum((F.col("truth") - mean) ** 2)).first()[0]


def _model_fill(fill, method):
    def run(spark, folder):
        st = staged(_hidden(_some(spark, folder, "TAIR", "DWPT", "PRES", "RELH", "WSPD")), "hidden")
        filled = staged(fill(st, SPEC, "TAIR", SMALL), "filled")
        return _facts(st, filled, "TAIR", method).withColumn("beats_mean", F.lit(_beats_mean(st, filled)))

    return run


def _model_fill_sql(method, left="0"):
    hidden = _facts_sql("TAIR", f"'{method}'", left).replace("FROM st", "FROM h")
    return with_station(f", h AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN TAIR END AS TAIR) FROM st) SELECT *, true AS beats_mean FROM ({hidden})")


AUTO = ("TAIR", "RELH", "WDIR", "VR05")


def _auto(spark, folder):
    """Method and outcome per variable when one model serves all sites."""
    st = staged(_hidden(_some(spark, folder, "DWPT", *AUTO)), "hidden")
    methods = impute_ml.choose_methods(st, SPEC, ["DWPT", *AUTO])
    filled, _, _ = jobs.fill_job(st, SPEC, "auto", SMALL)
    filled = staged(filled, "filled")
    # directions are compared by presence: the circle turns them into numbers of their own
    parts = [_facts(st, filled, v, methods.get(v)) for v in AUTO]
    # short runs are filled linearly, which follows no model
    learned = _beats_mean(st, filled) if methods.get("TAIR") in ("random_forest", "gradient_boosting") else None
    return reduce(DataFrame.unionByName, parts).withColumn("beats_mean", F.when(F.col("variable") == "TAIR", F.lit(learned)))


def _longest(variable):
    return (
        f"(SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT {SITE}, {variable}, count({variable}) OVER "
        f"(PARTITION BY {SITE} ORDER BY {TIME}, event_id) AS g FROM st) WHERE {variable} IS NULL GROUP BY {SITE}, g))"
    )


def _auto_sql():
    parts = []
    for v in AUTO:
        method = f"CASE WHEN {_longest(v)} = 0 THEN NULL WHEN {_longest(v)} <= 12 THEN 'linear' WHEN {_longest(v)} <= 48 THEN 'random_forest' ELSE 'gradient_boosting' END"
        # the linear fill can do nothing for a site that never reports; runs of 12 are within its reach
        left = f"CASE WHEN {_longest(v)} <= 12 THEN (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM st GROUP BY {SITE} HAVING count({v}) = 0)) ELSE 0 END"
        learned = f"CASE WHEN {_longest(v)} > 12 THEN true END" if v == "TAIR" else "NULL"
        parts.append(f"SELECT *, {learned} AS beats_mean FROM ({_facts_sql(v, method, left)})")
    whole = " UNION ALL ".join(parts).replace("FROM st", "FROM h")
    return with_station(f", h AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN TAIR END AS TAIR) FROM st) {whole}")


def _auto_by_site(spark, folder):
    """One of two stations filled by its own models, as written and read again; a name without rows
    changes nothing."""
    place = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    st = station(spark, folder, ["TAIR", "DWPT", "PRES"]).drop("event_type").withColumn(SITE, place)
    path = scratch_path(spark, "filled")
    jobs.fill_job(st, SPEC, "random_forest", SMALL, sites=["even", "nowhere"], variables=["TAIR"], out=path)
    filled = spark.read.parquet(f"{path}/filled")
    report = spark.read.schema("variable string, filled bigint").json(f"{path}/report")
    found = filled.groupBy(SITE).agg(F.count("*").alias("n"), F.count("TAIR").alias("known"))
    return found.join(report.select(F.lit("even").alias(SITE), F.col("filled")), SITE, "left")


AUTO_BY_SITE_SQL = with_station(
    ", s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS place, TAIR FROM st) "
    f"SELECT place AS {SITE}, count(*) AS n, CASE WHEN place = 'even' THEN count(*) ELSE count(TAIR) END AS known, "
    "CASE WHEN place = 'even' THEN count(*) - count(TAIR) END AS filled FROM s GROUP BY place"
)


QUERIES: dict[str, Query] = {
    "linear_fill": Query(lambda s, d: rounded(impute.linear_fill(_some(s, d, "TAIR", "RELH"), SPEC, ["TAIR", "RELH"], 2)), _linear_sql(["TAIR", "RELH"], 2)),
    "linear_fill_long_series": Query(
        lambda s, d: rounded(impute.linear_fill(station(s, d, ["VR05"]).drop(SITE).withColumn("event_type", F.lit("all")), HOT, ["VR05"], 3)),
        _linear_sql(["VR05"], 3, "event_type").replace("event_id, event_type,", "event_id, 'all' AS event_type,", 1),
    ),
    "circular_fill": Query(lambda s, d: _circle(impute.circular_fill(_some(s, d, "WDIR"), SPEC, ["WDIR"], 2)), CIRCLE_SQL),
    "zero_fill": Query(
        lambda s, d: rounded(impute.zero_fill(_some(s, d, "PRCP"))),
        with_station(f"SELECT {KEYS}, {r('coalesce(PRCP, 0)', 'PRCP')} FROM st"),
    ),
    "forward_backward_fill": Query(
        lambda s, d: rounded(impute.forward_backward_fill(_some(s, d, "TAIR", "VR05", "PRCP"), SPEC, ["TAIR", "VR05", "PRCP"], 2)),
        _both_ways_sql(["TAIR", "VR05"], ["PRCP"], 2),
    ),
    "fill_all": Query(lambda s, d: rounded(impute.fill_all(_some(s, d, "TAIR", "VR05"), SPEC, ["TAIR", "VR05"])), _fill_all_sql(["TAIR", "VR05"])),
    "mean_fill": Query(
        lambda s, d: rounded(impute.mean_fill(_some(s, d, "TAIR", "RELH"), ["TAIR", "RELH"])),
        with_station(f"SELECT {KEYS}, " + ", ".join(r(f"coalesce({c}, (SELECT avg({c}) FROM st))", c) for c in ("TAIR", "RELH")) + " FROM st"),
    ),
    "median_fill": Query(
        lambda s, d: rounded(impute.median_fill(_some(s, d, "TAIR", "RELH"), ["TAIR", "RELH"], _some(s, d, "TAIR", "RELH", "PRES").where("event_id % 3 = 0"))),
        with_station(
            f"SELECT {KEYS}, " + ", ".join(r(f"coalesce({c}, (SELECT median({c}) FROM st WHERE event_id % 3 = 0))", c) for c in ("TAIR", "RELH")) + " FROM st"
        ),
    ),
    "fill_evaluation": Query(_evaluation, EVALUATION_SQL),
    "forest_fill": Query(_model_fill(impute_ml.forest_fill, "random_forest"), _model_fill_sql("random_forest")),
    "boosted_fill": Query(
        _model_fill(impute_ml.boosted_fill, "gradient_boosting"),
        # a series' first row lacks six lags of fourteen features, too many to be filled
        _model_fill_sql(
            "gradient_boosting",
            f"(SELECT count(*) FROM (SELECT TAIR, row_number() OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id) AS n FROM st) WHERE n = 1 AND TAIR IS NULL)",
        ),
    ),
    "auto_fill": Query(_auto, _auto_sql()),
    "auto_fill_by_site": Query(_auto_by_site, AUTO_BY_SITE_SQL),
}
