"""Queries on splits, scores, rankings, models and their explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from inversia.operators import ml, modeling
from inversia.plans import jobs
from inversia.queries.views import HOT, LINE_KEYS, LINES, SITE, SPEC, TIME, Query, lines, r, rounded, station, table, with_station
from inversia.session import scratch_path, staged

KEYS_SQL = ", ".join(LINE_KEYS)
ORDER_SQL = "PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
FEATURES = ("l_quantity", "l_discount", "l_tax")
# A fixed linear predictor of the price; its rows are what a model would return.
FORMULA = "l_quantity * 1500.5e0 + l_discount * 20000.25e0 - l_tax * 1000.75e0"


def _predictions(spark, folder):
    """Three closed-form predictors of the price, stacked by model."""
    li = lines(spark, folder)
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("prediction")) for m, e in PREDICTORS.items()]
    )
    return li.select(F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("target"), F.col("l_extendedprice").alias("label"), F.inline(models))


PREDICTORS = {
    "linear": FORMULA,
    "flat": "36000.0e0 + l_discount",
    "quantity": "l_quantity * 1475.25e0",
}
STACK_SQL = "s AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS site, l_linestatus AS target, l_extendedprice AS y, '{m}' AS model, {e} AS p FROM lineitem" for m, e in PREDICTORS.items()
) + ")"
SCORE_SQL = (
    f"{r('sqrt(avg((y - p) * (y - p)))', 'rmse', 3)}, {r('avg(abs(y - p))', 'mae', 3)}, {r('1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y))', 'r2')}"
)


def _results(spark, folder):
    found = modeling.scores(_predictions(spark, folder), ["site", "target", "model"])
    return found.select("site", "target", "model", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


def _brands(spark, folder):
    """One row per brand, in the place of one per feature."""
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.avg("p_retailprice").alias("importance"),
        F.avg("p_size").alias("perm_importance_mean"),
        F.max("p_retailprice").alias("top_price"),
        F.stddev_pop("p_size").alias("shap_importance"),
    )


BRANDS_SQL = (
    "b AS (SELECT p_brand AS feature, avg(p_retailprice) AS importance, avg(p_size) AS perm_importance_mean, max(p_retailprice) AS top_price, "
    "stddev_pop(p_size) AS shap_importance FROM part GROUP BY p_brand)"
)
RANKS_SQL = (
    "k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rf_rank, row_number() OVER (ORDER BY perm_importance_mean DESC, feature) AS perm_rank, "
    "row_number() OVER (ORDER BY shap_importance DESC, feature) AS shap_rank FROM b)"
)


def _compared(spark, folder):
    b = _brands(spark, folder)
    forest = b.select("feature", "importance", "perm_importance_mean")
    return modeling.compare_methods(forest, b.select("feature", "shap_importance"))


def _report(spark, folder):
    """Top brands by price and size in every region, in the place of features per site."""
    part = table(spark, folder, "part").withColumn("site", F.col("p_type"))
    per = part.groupBy("site", F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    found = modeling.significance_report(
        {"price": per.select("site", "feature", F.col("a").alias("score")), "size": per.select("site", "feature", F.col("b").alias("score"))}, 3
    )
    return rounded(found)


REPORT_SQL = (
    "WITH p AS (SELECT p_type AS site, p_brand AS feature, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY ALL) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS method, site, feature, {r(c, 'score')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {c} DESC, feature) AS rank FROM p) WHERE rank <= 3"
        for m, c in (("price", "a"), ("size", "b"))
    )
)


def _matrix(spark, folder):
    """Inversion rows with a target one step on, mean-filled."""
    from inversia.operators.windows import add_targets

    st = add_targets(station(spark, folder).withColumn("VT_inversion_90_20", F.col("VT90") - F.col("VT20")), SPEC, ["VT20"], [1])
    out = modeling.model_matrix(st, ["TAIR", "RELH", "PRES"], "VT20_target_1h", [SITE, TIME, "event_id"], focus_inversion=True)
    return rounded(out)


def _training(spark, folder):
    """Rows per site and split when one sensor never reports and one site lacks another."""
    st = station(spark, folder, ["TAIR", "RELH", "PRES", "VT20", "VT90"]).drop("event_type")
    st = st.withColumns(
        {"SRAD": F.lit(None).cast("double"), "PRES": F.when(F.col(SITE) != "1", F.col("PRES")), "VT_inversion_90_20": F.col("VT90") - F.col("VT20")}
    )
    matrix, used = jobs.training_matrix(st, SPEC, ["TAIR", "RELH", "PRES", "SRAD"], "VT20", False)
    counted = matrix.groupBy(SITE, "is_train").agg(
        F.count("*").alias("n"), F.count("PRES").alias("n_filled"), F.sum("PRES").alias("pres")
    )
    return rounded(counted.withColumn("columns", F.lit(",".join(used))), 4)


TRAINING_SQL = with_station(
    f", s AS (SELECT {SITE}, CASE WHEN {SITE} <> '1' THEN PRES END AS p, row_number() OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id) - 1 "
    f"< floor(count(*) OVER (PARTITION BY {SITE}) * 0.8e0) AS is_train FROM st WHERE VT20 IS NOT NULL) "
    f"SELECT {SITE}, is_train, count(*) AS n, count(*) AS n_filled, {r('sum(coalesce(p, (SELECT avg(p) FROM s WHERE is_train)))', 'pres', 4)}, "
    f"'TAIR,RELH,PRES' AS columns FROM s GROUP BY {SITE}, is_train"
)


MATRIX_SQL = with_station(
    f", t AS (SELECT *, lead(VT20) OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id) AS y FROM st), "
    "m AS (SELECT * FROM t WHERE y IS NOT NULL AND VT90 - VT20 > 0) "
    f"SELECT {SITE}, {TIME}, event_id, {r('y', 'VT20_target_1h')}, "
    + ", ".join(r(f"coalesce({c}, (SELECT avg({c}) FROM m))", c) for c in ("TAIR", "RELH", "PRES"))
    + " FROM m"
)


# -- permutation importance of the fixed predictor -----------------------------------------------
REPEATS, ROWS_ORDER = 3, "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31 + l_suppkey + {r} * 15485863) % 1000003"


def fixed_scorer(rows):
    """The linear predictor over an assembled vector."""
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    return rows.withColumn("prediction", x[0] * 1500.5 + x[1] * 20000.25 - x[2] * 1000.75)


def _permutation(spark, folder):
    table_ = ml.assemble(lines(spark, folder).select(*LINE_KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice"), FEATURES, "l_extendedprice")
    found = ml.permutation_importance(
        fixed_scorer, table_.select(*LINE_KEYS, "features", "label"), FEATURES, LINE_KEYS, REPEATS,
        draw=lambda k: F.expr(ROWS_ORDER.format(r=k)),
    )
    return rounded(found)


def _permutation_sql():
    parts = []
    for k in range(REPEATS):
        order = f"{ROWS_ORDER.format(r=k)}, {KEYS_SQL}"
        shifted = ", ".join(
            f"coalesce(lead({f}) OVER (ORDER BY {order}), first_value({f}) OVER (ORDER BY {order})) AS n_{f}" for f in FEATURES
        )
        for f in FEATURES:
            e = FORMULA.replace(f, f"n_{f}")
            parts.append(f"SELECT '{f}' AS feature, 1 - sum((y - ({e})) * (y - ({e}))) / (count(*) * var_pop(y)) AS r2 FROM o{k}")
        if k == 0:
            ctes = []
        ctes.append(f"o{k} AS (SELECT l_extendedprice AS y, {', '.join(FEATURES)}, {shifted} FROM lineitem)")
    base = f"(SELECT 1 - sum((l_extendedprice - ({FORMULA})) * (l_extendedprice - ({FORMULA}))) / (count(*) * var_pop(l_extendedprice)) FROM lineitem)"
    return (
        f"WITH {', '.join(ctes)}, a AS ({' UNION ALL '.join(parts)}) "
        f"SELECT feature, {r(f'avg({base} - r2)', 'perm_importance_mean')}, {r(f'stddev_pop({base} - r2)', 'perm_importance_std')} FROM a GROUP BY feature"
    )


# -- Shapley values of the fixed predictor ---------------------------------------------------------
DRAWS = 4
BACKGROUND_ORDER = ROWS_ORDER.format(r=9)
PARTNER = "l_orderkey * 613 + l_linenumber * 7919 + l_partkey + {draw} * 104729"
ONE_ROW = "l_orderkey % 500 = 3 AND l_linenumber = 1"
WEIGHTS = {"l_quantity": "1500.5e0", "l_discount": "20000.25e0", "l_tax": "-1000.75e0"}


def _assembled(spark, folder):
    # written once: training and test rows are planned, counted and numbered apart
    split = staged(modeling.chronological_split(lines(spark, folder).select(*LINE_KEYS, *FEATURES, "l_extendedprice"), LINES), "split")
    rows = ml.assemble(split, FEATURES, "l_extendedprice").select(*LINE_KEYS, "features", "label", "is_train")
    return rows.where("is_train"), rows.where(~F.col("is_train"))


def _shapley(spark, folder, asked="true"):
    """Every test row that is asked for explained against all training rows."""
    train, test = _assembled(spark, folder)
    test = test.where(asked)
    return ml.shapley_values(
        fixed_scorer, test, train, FEATURES, LINE_KEYS, DRAWS, order=F.expr(BACKGROUND_ORDER), partner=lambda draw: F.expr(PARTNER.format(draw="_draw"))
    )


PHI_SQL = (
    f"WITH s AS (SELECT {KEYS_SQL}, {', '.join(FEATURES)}, row_number() OVER ({ORDER_SQL}) - 1 < floor(count(*) OVER (PARTITION BY l_returnflag) * 0.8e0) AS is_train "
    f"FROM lineitem), b AS (SELECT row_number() OVER (ORDER BY {BACKGROUND_ORDER}, {KEYS_SQL}) - 1 AS b, {', '.join(f'{f} AS z_{f}' for f in FEATURES)} FROM s WHERE is_train), "
    f"t AS (SELECT *, row_number() OVER () AS id FROM s WHERE NOT is_train), d AS (SELECT unnest(range({DRAWS})) AS draw), "
    f"p AS (SELECT t.*, ({PARTNER.format(draw='draw')}) % (SELECT count(*) FROM b) AS b FROM t, d), "
    "phi AS ("
    + " UNION ALL ".join(
        f"SELECT {KEYS_SQL}, '{f}' AS feature, avg({w} * ({f} - z_{f})) AS phi FROM p JOIN b USING (b) GROUP BY id, {KEYS_SQL}" for f, w in WEIGHTS.items()
    )
    + ") "
)


# -- fitted models: what can be told of them without fitting -----------------------------------------
TEST_ROWS = "sum(n - floor(n * 0.8e0)) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)"


LEARNED = (*FEATURES, "noise")


def _learnable(spark, folder, folds=0):
    """Training and test rows whose label follows from three of four columns; the fourth is a hash."""
    noise = F.pmod(F.xxhash64(*LINE_KEYS), F.lit(10_000)) / 10_000.0
    rows = lines(spark, folder).select(*LINE_KEYS, *FEATURES, noise.alias("noise"), F.expr(FORMULA).cast("double").alias("made"))
    # written once: every pass of a fit, and every model that predicts, reads it
    split = staged(modeling.chronological_split(rows, LINES, folds=folds), "learnable")
    made = ml.assemble(split, LEARNED, "made").select(*LINE_KEYS, "features", "label", "is_train", *(["fold"] if folds else []))
    return made.where("is_train"), made.where(~F.col("is_train"))


def _better(rows, *by):
    """Whether predictions miss by less than half of what the mean misses by."""
    missed = F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))
    return rows.groupBy(*by).agg((missed < 0.5 * F.stddev_pop("label")).alias("beats_mean"))


def _forest(spark, folder):
    train, test = _learnable(spark, folder)
    model = ml.fit_forest(train.select("features", "label"), trees=20, depth=6)
    importance = ml.importance_table(model, LEARNED, train)
    shares = {r["feature"]: r["importance"] for r in importance.collect()}
    scored = model.transform(test)
    missed = F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))
    found = scored.agg(F.count("prediction").alias("n"), (missed < 0.5 * F.stddev_pop("label")).alias("better")).first()
    return importance.select(
        "feature",
        F.col("importance").between(0, 1).alias("in_range"),
        F.lit(round(sum(shares.values()), 6)).alias("total"),
        # what the label follows from is far above the hash
        (F.col("importance") == F.lit(max(shares.values()))).alias("strongest"),
        F.lit(shares["noise"] < 0.01 * shares["l_quantity"]).alias("above_noise"),
        F.lit(found["n"]).cast("bigint").alias("scored_rows"),
        F.lit(found["better"]).alias("beats_mean"),
    )


def _boosted(spark, folder):
    """Rows that each variant and their stack predict, and whether they learn."""
    train, test = _learnable(spark, folder, ml.FOLDS)
    _, predictions = ml.train_all(train, test, LINES)
    predictions = staged(predictions.select("model", "label", "prediction"), "predictions")
    counted = predictions.groupBy("model").agg(F.count("prediction").alias("scored_rows"))
    return counted.join(_better(predictions, "model"), "model")


def _two_sites(spark, folder, sensors):
    """Two stations that share all events between them."""
    place = F.when(F.col("event_type").isin("click", "view"), "north").otherwise("south")
    return station(spark, folder, sensors).withColumn(SITE, place).drop("event_type")


def _feature_sinks(spark, folder):
    """Feature, event and summary tables as written, counted after reading."""
    st = _two_sites(spark, folder, ["TAIR", "PRES", "VT05", "VT20", "VT90"])
    path = scratch_path(spark, "features")
    jobs.save_features(jobs.build_features(st, SPEC), path, SPEC)
    features = spark.read.parquet(f"{path}/features").groupBy(SITE).agg(F.count("*").alias("feature_rows"))
    events = spark.read.parquet(f"{path}/events").groupBy(SITE).agg(F.count("*").alias("event_rows"))
    summary = spark.read.schema(f"{SITE} string, steps bigint, events bigint").json(f"{path}/summary")
    return features.join(events, SITE).join(summary, SITE)


SINKS_SQL = with_station(
    ", s AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS site, VT90 - VT05 AS s FROM st), "
    f"f AS (SELECT site, s > 0 AND coalesce(lag(s) OVER (PARTITION BY site ORDER BY {TIME}, event_id), -1) <= 0 AS first FROM s) "
    f"SELECT site AS {SITE}, count(*) AS feature_rows, count(*) FILTER (first) AS event_rows, count(*) AS steps, count(*) FILTER (first) AS events FROM f GROUP BY site"
)


def _forecast(sites):
    def run(spark, folder):
        st = _two_sites(spark, folder, ["TAIR", "WSPD", "PRES", "DWPT", "VT05", "VT20", "VT90"])
        features = jobs.build_features(st, SPEC)  # the job writes what its models read
        columns = ["WSPD", "PRES", "VT05", "VT20", "VT90", "hour_sin", "VT20_lag_1", "VT90_rolling_mean_3"]
        asked = None if sites is None else [*sites, "nowhere"]
        # one target that nothing tells, one step on, and one that the features tell
        targets = {"VT20": "VT20_target_1h", "DWPT": "DWPT"}
        found = jobs.forecast_job(features, SPEC, targets, rounds=2, depth=2, folds=2, columns=columns, sites=asked)
        by = ["site", "target", "model"]
        counted = found["predictions"].groupBy(*by).agg(F.count("prediction").alias("n"))
        counted = counted.join(_better(found["predictions"], *by).withColumn("beats_mean", F.when(F.col("target") == "DWPT", F.col("beats_mean"))), by)
        best = found["best"].groupBy("site", "target").agg(F.count("model").alias("best"))
        importance = found["importance"].groupBy("site", "target", "model").agg(F.round(F.sum("importance"), 6).alias("importance"))
        if sites is None:  # one set of models for all sites
            counted = counted.join(importance.drop("site"), ["target", "model"], "left")
        else:
            counted = counted.join(importance, ["site", "target", "model"], "left")
        failed = found["failures"].select("site", "target", F.lit("none").alias("model"))
        return counted.join(best, ["site", "target"]).unionByName(failed, allowMissingColumns=True)

    return run


def _forecast_sql(failed):
    counts = with_station(
        ", s AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS site FROM st), "
        f"t AS (SELECT site, VT90, VT05, unnest(['VT20', 'DWPT']) AS target, unnest([lead(VT20) OVER (PARTITION BY site ORDER BY {TIME}, event_id), DWPT]) AS y FROM s), "
        "c AS (SELECT site, target, count(*) - floor(count(*) * 0.8e0) AS n FROM t WHERE y IS NOT NULL AND VT90 - VT05 > 0 GROUP BY site, target), "
        "m AS (SELECT unnest(['gbt_row_col', 'gbt_col', 'gbt_full', 'stacked']) AS model) "
        "SELECT site, target, model, cast(n AS bigint) AS n, CASE WHEN target = 'DWPT' THEN true END AS beats_mean, CASE WHEN model <> 'stacked' THEN 1.0e0 END AS importance, 1 AS best FROM c, m"
    )
    return counts + ("".join(f" UNION ALL SELECT 'nowhere', '{t}', 'none', NULL, NULL, NULL, NULL" for t in ("VT20", "DWPT")) if failed else "")


def _significance(sites, pooled):
    def run(spark, folder):
        """Importance of the sensors and the time for the surface difference; all rows explained."""
        st = _two_sites(spark, folder, ["TAIR", "PRES", "WSPD", "VT20", "VT90"]).withColumn("noise", F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0)
        found = jobs.significance_job(
            st, SPEC, ["TAIR_VT20"], exclude_inputs=True, pooled=pooled, k=5, sites=sites, trees=5, depth=4, repeats=2, permutations=2
        )
        ranks = found["report"].groupBy("site", "target", "method").agg(
            F.count("*").alias("reported"), F.max("rank").alias("last_rank"), F.countDistinct("feature").alias("features"),
            F.max_by("feature", -F.col("rank")).alias("strongest"),
        )
        compared = found["comparison"].groupBy("site", "target").agg(F.count("*").alias("compared"))
        return ranks.join(found["explained"], ["site", "target"]).join(compared, ["site", "target"])

    return run


def _significance_sql(groups):
    parts = []
    for name, condition in groups.items():
        parts.append(
            f"SELECT '{name}' AS site, count(*) AS n FROM s, (SELECT avg(d) AS a, stddev_samp(d) AS b FROM s WHERE {condition}) WHERE {condition} AND abs(d - a) / b < 3"
        )
    return with_station(
        ", s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS place, TAIR - VT20 AS d FROM st WHERE TAIR IS NOT NULL), "
        f"n AS ({' UNION ALL '.join(parts)}) SELECT site, 'TAIR_VT20' AS target, method, 5 AS reported, 5 AS last_rank, 5 AS features, 'WSPD' AS strongest, n AS explained_rows, 8 AS compared "
        "FROM n, (SELECT unnest(['impurity', 'permutation', 'shapley']) AS method)"
    )


def _null_times(spark, folder):
    """Long series in which every seventh event has lost its time."""
    events = table(spark, folder, "events")
    return events.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias(TIME))


QUERIES: dict[str, Query] = {
    "chronological_split": Query(
        lambda s, d: modeling.chronological_split(lines(s, d).select(*LINE_KEYS), LINES),
        f"SELECT {KEYS_SQL}, row_number() OVER ({ORDER_SQL}) - 1 < floor(count(*) OVER (PARTITION BY l_returnflag) * 0.8e0) AS is_train FROM lineitem",
    ),
    "split_null_times_long_series": Query(
        lambda s, d: modeling.chronological_split(_null_times(s, d), HOT).select("event_id", "is_train"),
        f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 7 <> 0 THEN ts END NULLS FIRST, event_id) - 1 "
        "< floor(count(*) OVER (PARTITION BY event_type) * 0.8e0) AS is_train FROM events",
    ),
    "contiguous_folds": Query(
        lambda s, d: modeling.contiguous_folds(lines(s, d).select(*LINE_KEYS), LINES),
        f"SELECT {KEYS_SQL}, cast(ntile(5) OVER ({ORDER_SQL}) - 1 AS int) AS fold FROM lineitem",
    ),
    "thin_series": Query(
        lambda s, d: modeling.thin(lines(s, d).select(*LINE_KEYS), LINES, 100),
        f"WITH n AS (SELECT {KEYS_SQL}, row_number() OVER ({ORDER_SQL}) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) "
        f"SELECT {KEYS_SQL} FROM n WHERE i IN (SELECT (k * (n.c - 1)) // 99 FROM (SELECT unnest(range(100)) AS k))",
    ),
    "model_matrix": Query(_matrix, MATRIX_SQL),
    "training_matrix": Query(_training, TRAINING_SQL),
    "regression_scores": Query(
        lambda s, d: modeling.scores(_predictions(s, d), ["model"]).select("model", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2")),
        f"WITH {STACK_SQL} SELECT model, {SCORE_SQL} FROM s GROUP BY model",
    ),
    "results_table": Query(_results, f"WITH {STACK_SQL} SELECT site, target, model, {SCORE_SQL} FROM s GROUP BY ALL"),
    "best_models": Query(
        lambda s, d: modeling.best_models(_results(s, d)),
        f"WITH {STACK_SQL}, t AS (SELECT site, target, model, {SCORE_SQL} FROM s GROUP BY site, target, model) "
        "SELECT site, target, arg_min(model, (rmse, model)) AS model, arg_min(rmse, (rmse, model)) AS rmse, arg_min(r2, (rmse, model)) AS r2 FROM t GROUP BY site, target",
    ),
    "importance_ranks": Query(
        lambda s, d: rounded(modeling.importance_ranks(_brands(s, d)).select("feature", "importance", "perm_importance_mean", "rf_rank", "perm_rank")),
        f"WITH {BRANDS_SQL}, {RANKS_SQL} SELECT feature, {r('importance', 'importance')}, {r('perm_importance_mean', 'perm_importance_mean')}, rf_rank, perm_rank FROM k",
    ),
    "compare_methods": Query(
        lambda s, d: rounded(_compared(s, d)),
        f"WITH {BRANDS_SQL}, {RANKS_SQL} SELECT feature, {r('importance', 'importance')}, {r('perm_importance_mean', 'perm_importance_mean')}, rf_rank, "
        f"{r('shap_importance', 'shap_importance')}, shap_rank, (rf_rank + shap_rank) / 2 AS avg_rank FROM k",
    ),
    "rank_correlation": Query(
        lambda s, d: rounded(modeling.rank_correlation(_compared(s, d), "rf_rank", "shap_rank")),
        f"WITH {BRANDS_SQL}, {RANKS_SQL} SELECT {r('corr(rf_rank, shap_rank)', 'spearman')} FROM k",
    ),
    "rank_correlation_top15": Query(
        lambda s, d: rounded(modeling.rank_correlation(_compared(s, d).limit(15), "rf_rank", "shap_rank")),
        f"WITH {BRANDS_SQL}, {RANKS_SQL}, t AS (SELECT * FROM k ORDER BY (rf_rank + shap_rank) / 2, rf_rank LIMIT 15), "
        "q AS (SELECT rank() OVER (ORDER BY rf_rank) AS a, rank() OVER (ORDER BY shap_rank) AS b FROM t) "
        f"SELECT {r('corr(a, b)', 'spearman')} FROM q",
    ),
    "top_k": Query(
        lambda s, d: rounded(modeling.top_k(_brands(s, d).select("feature", "importance"), "importance", 10)),
        f"WITH {BRANDS_SQL} SELECT feature, {r('importance', 'importance')} FROM b ORDER BY b.importance DESC, feature LIMIT 10",
    ),
    "significance_report": Query(_report, REPORT_SQL),
    "permutation_importance": Query(_permutation, _permutation_sql()),
    "sample_rows": Query(
        lambda s, d: modeling.sample_rows(lines(s, d), LINE_KEYS, 1000).select(*LINE_KEYS),
        f"SELECT {KEYS_SQL} FROM lineitem ORDER BY md5(concat_ws('|', '42', {', '.join(f'cast({k} AS varchar)' for k in LINE_KEYS)})), {KEYS_SQL} LIMIT 1000",
    ),
    "forest_importance": Query(
        _forest,
        f"SELECT feature, true AS in_range, 1.0e0 AS total, feature = 'l_quantity' AS strongest, true AS above_noise, (SELECT cast({TEST_ROWS.replace(' FROM', ' AS bigint) FROM', 1)}) AS scored_rows, true AS beats_mean "
        f"FROM (SELECT unnest([{', '.join(repr(f) for f in LEARNED)}]) AS feature)",
    ),
    "shapley_values": Query(lambda s, d: rounded(_shapley(s, d)), PHI_SQL + f"SELECT {KEYS_SQL}, feature, {r('phi', 'phi')} FROM phi"),
    "shapley_importance": Query(
        lambda s, d: rounded(ml.shapley_importance(_shapley(s, d))), PHI_SQL + f"SELECT feature, {r('avg(abs(phi))', 'shap_importance')} FROM phi GROUP BY feature"
    ),
    "shapley_spread": Query(
        lambda s, d: rounded(ml.shapley_spread(staged(_shapley(s, d).select("feature", "phi"), "phi"))),
        PHI_SQL
        + f"SELECT feature, {r('min(phi)', 'low')}, {r('quantile_cont(phi, 0.25)', 'q1')}, {r('median(phi)', 'median')}, {r('quantile_cont(phi, 0.75)', 'q3')}, {r('max(phi)', 'high')} "
        "FROM phi GROUP BY feature",
    ),
    "explain_row": Query(
        lambda s, d: rounded(ml.explain_row(_shapley(s, d, ONE_ROW), F.expr(ONE_ROW))), PHI_SQL + f"SELECT {KEYS_SQL}, feature, {r('phi', 'phi')} FROM phi WHERE {ONE_ROW}"
    ),
    "boosted_and_stacked": Query(
        _boosted,
        f"SELECT unnest(['gbt_row_col', 'gbt_col', 'gbt_full', 'stacked']) AS model, (SELECT cast({TEST_ROWS.replace(' FROM', ' AS bigint) FROM', 1)}) AS scored_rows, true AS beats_mean",
    ),
    "feature_sinks": Query(_feature_sinks, SINKS_SQL),
    "forecast": Query(_forecast(None), _forecast_sql(False)),
    "forecast_by_site": Query(_forecast(["north", "south"]), _forecast_sql(True)),
    "significance": Query(_significance((), True), _significance_sql({"combined": "true"})),
    "significance_by_site": Query(
        _significance(["north", "south", "nowhere"], False), _significance_sql({"north": "place = 'north'", "south": "place = 'south'"})
    ),
}
