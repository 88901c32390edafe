"""End-to-end jobs, each a composition of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inversia.functions.calendar import calendar_parts, cyclic_columns, model_time_columns, season_columns
from inversia.functions.coercion import existing, finite
from inversia.functions.weather import (
    interaction_columns,
    inversion_columns,
    physics_columns,
    soil_columns,
    surface_columns,
)
from inversia.operators import filters, impute, impute_ml, ml, modeling, quality, spatial, windows
from inversia.plans.joins import match
from inversia.plans.layout import settled
from inversia.plans.series import SeriesSpec
from inversia.session import staged
from inversia.sources import raster, sinks
from inversia.sources.stations import COUNTY, SITE, TIME

STATION = SeriesSpec((SITE,), TIME)
# Columns that get lags and rolling statistics, and those that get targets.
CORE = ("TAIR", "DWPT", "PRES", "RELH", "WSPD", "SRAD", "VT05", "VT20", "VT90", "VT_inversion_90_05")
FORECAST = ("VT20", "VT90", "VT_inversion_90_20", "VT_inversion_90_05", "TAIR")
FORECAST_TARGETS = {"VT20": "VT20_target_1h", "VT90": "VT90_target_1h", "VT_diff": "VT_inversion_90_20_target_1h"}
# Derived columns that divide by a sensor; only these can leave the finite numbers by themselves.
QUOTIENTS = {"VT20_VT90_ratio", "potential_temp", "virtual_temp_calc"}
# Row-wise columns whose far quantiles are capped.
CAPPED = (
    "VT20_VT90_ratio", "VT_profile_curvature", "temp_dewpoint_spread", "wind_u", "wind_v",
    "potential_temp", "sat_vapor_pressure", "vapor_pressure", "virtual_temp_calc",
)
TEST_SHARE = 0.2
SITE_EFFECT, POOLED, COMBINED = "site_mean", "all", "combined"


def build_features(df: DataFrame, spec: SeriesSpec = STATION) -> DataFrame:
    """The full feature table: about 280 columns, one shuffle on the site.

    Extremes are looked for in the row-wise columns, before the window pass: a lag, a mean or a
    difference of values below the trigger cannot pass it. Only if a column holds such values
    are the tables cleaned column by column. Otherwise row-wise columns that no window reads are
    made behind the window pass, so that sensors are what is shuffled and sorted."""
    have = df.columns
    ids = (*spec.site, spec.ts, COUNTY, *spec.tiebreak)
    typed = filters.numeric_only(df, ids)
    sensors = [f.name for f in typed.schema.fields if f.dataType.simpleString() in ("double", "float")]
    base = typed.select(*[finite(F.col(c)).alias(c) if c in sensors else F.col(c) for c in typed.columns])
    derived = {
        **calendar_parts(F.col(spec.ts)),
        **season_columns(F.col(spec.ts)),
        **cyclic_columns(F.col(spec.ts)),
        **inversion_columns(have),
        **surface_columns(have),
        **soil_columns(have),
        **physics_columns(have),
        **interaction_columns(have),
    }
    rowwise = base.select("*", *[(finite(c) if n in QUOTIENTS else c).alias(n) for n, c in derived.items()])
    numeric = [f.name for f in rowwise.schema.fields if f.dataType.simpleString() in ("double", "float")]

    def peaks(*columns: Sequence[str]) -> list[float]:
        return list(rowwise.agg(*[F.greatest(*[F.max(F.abs(c)) for c in some], F.lit(0.0), F.lit(0.0)) for some in columns]).first())

    # what is no quotient is at most a product of two sensors or some sensors' sum times 1000 / 85
    sensor, quotient = peaks(sensors, [c for c in numeric if c in QUOTIENTS])
    wild = not max((sensor + 100) ** 2, quotient) * 4 <= 1e10 and not peaks(numeric)[0] * 4 <= 1e10
    core = existing(rowwise, CORE)
    forecast = existing(rowwise, FORECAST)

    def build(f: windows.Frames):
        return {
            **windows.difference_columns(have, f),
            **windows.lag_columns(core, f),
            **windows.rolling_columns(core, f),
            **windows.target_columns(forecast, f),
        }

    never = float("inf")
    if wild:
        rowwise = windows.clean_extremes(rowwise, CAPPED, CAPPED, any_trigger=never)
    early = rowwise if wild else rowwise.select(*base.columns, *[n for n in derived if n in (*core, *forecast)])
    wide = windows.add_windowed(
        early, spec, build, lookback=max(windows.ROLLING), lookahead=max(windows.HORIZONS)
    )
    if not wild:
        late = [(finite(c) if n in QUOTIENTS else c).alias(n) if n not in early.columns else F.col(n) for n, c in derived.items()]
        wide = wide.select(*base.columns, *late, *wide.columns[len(early.columns):])
    if wild:
        steps = list(windows.difference_columns(have, windows.Frames(spec.window())))
        wide = windows.clean_extremes(wide, steps, steps, any_trigger=never)
        reals = [f.name for f in wide.schema.fields if f.dataType.simpleString() in ("double", "float")]
        wide = windows.clean_extremes(wide, reals)
    return wide


def save_features(features: DataFrame, folder: str, spec: SeriesSpec = STATION) -> None:
    """Feature table, event table and event summary; events and summary are made from the written
    table, so that its window pass runs once."""
    sinks.write_table(features, f"{folder}/features")
    features = features.sparkSession.read.schema(features.schema).parquet(f"{folder}/features")
    spec = settled(features, spec)
    strength = F.col("VT_inversion_90_05")
    sinks.write_table(windows.inversion_events(features, spec, strength), f"{folder}/events")
    sinks.write_summary(windows.event_summary(features, spec, strength), f"{folder}/summary")


def side_by_side(spark: SparkSession, tasks: dict[tuple, Callable[[], object]], workers: int) -> tuple[dict[tuple, object], list[tuple]]:
    """Independent Spark jobs from a bounded pool of driver threads: what they return, and for those
    that fail their key with the error. One failure doesn't stop the others."""
    done, failed = {}, []
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        running = {key: pool.submit(inheritable_thread_target(spark)(task)) for key, task in tasks.items()}
        for key, future in running.items():
            try:
                done[key] = future.result()
            except Exception as problem:  # reported as a row
                failed.append((*key, f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"))
    return done, failed


def fill_job(
    df: DataFrame,
    spec: SeriesSpec = STATION,
    method: str = "auto",
    models: impute_ml.FillModels = impute_ml.FillModels(),
    sites: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    workers: int = 4,
    out: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filled table, fill report, and (site, error) of sites that failed.

    One model per variable for all sites; with ``sites`` those listed are filled by models of
    their own, several at a time, and other or failing ones keep their gaps. ``out``: where the
    table and the report are written."""
    if sites is None:
        filled, failed = impute_ml.fill_gaps(df, spec, method, variables, models), []
    else:
        spark, site = df.sparkSession, spec.site[0]
        table = staged(df, "fill")
        tasks = {
            (name,): partial(_filled_site, filters.site_rows(table, site, name), spec, method, variables, models) for name in dict.fromkeys(sites)
        }
        done, failed = side_by_side(spark, tasks, workers)
        rest = table.where(F.coalesce(~F.col(site).isin([name for (name,) in done]), F.lit(True))) if done else table
        filled = reduce(partial(DataFrame.unionByName, allowMissingColumns=False), done.values(), _typed_like(rest, done))
        df = table
    report = quality.fill_report(df, filled, existing(df, variables or impute.SENSORS))
    if out is not None:
        sinks.write_table(filled, f"{out}/filled")
        sinks.write_summary(report, f"{out}/report")
    return filled, report, df.sparkSession.createDataFrame(failed, "site string, error string")


def _filled_site(rows: DataFrame, *arguments) -> DataFrame:
    return staged(impute_ml.fill_gaps(rows, *arguments), "filled")


def _typed_like(rest: DataFrame, done: dict[tuple, DataFrame]) -> DataFrame:
    """Sites left alone, with the column types of the filled ones."""
    if not done:
        return rest
    schema = next(iter(done.values())).schema
    return rest.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def continuity_report(df: DataFrame, spec: SeriesSpec = STATION, expected_s: float = 1800, tolerance_s: float = 300) -> dict[str, DataFrame]:
    """Continuous periods, gaps, and completeness."""
    spec = settled(df, spec)
    return {
        "periods": quality.continuous_periods(df, spec, expected_s, tolerance_s),
        "gaps": quality.time_gaps(df, spec, expected_s, tolerance_s),
        "completeness": quality.completeness(df, spec, expected_s, tolerance_s),
    }


def cleaning_job(raw: DataFrame, typed: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> dict[str, DataFrame]:
    """What was lost to coercion, the complete subset, and where complete data lies. ``typed`` may
    have lost rows of ``raw`` (units rows), so the two are laid out apart."""
    log = quality.missing_log(raw, spec, columns)
    return {
        "log": log,
        "log_summary": quality.missing_log_summary(log),
        "raw_values": quality.first_raw_values(raw, spec, columns),
        "incomplete": filters.incomplete_rows(typed, columns),
        "complete": filters.complete_rows(typed, columns),
        "chunks": quality.complete_chunks(typed, spec, columns),
        "availability": quality.availability(typed, spec.ts, columns),
    }


def training_matrix(
    features: DataFrame, spec: SeriesSpec, columns: Sequence[str], target: str, focus_inversion: bool,
    fit_on: str = "train", site_effect: bool = False,
) -> tuple[DataFrame, list[str]]:
    """All rows with a known target, ``is_train``, and the columns that can be learned from.

    Null cells take the mean of the training rows (``fit_on="all"``: of all rows). A column
    without a known value among those is left out; no row is. ``site_effect`` adds the site's mean
    training target as a column, so that one model can serve all sites."""
    rows = features.where(F.col(target).isNotNull())
    if focus_inversion:
        rows = filters.inversion_rows(rows)
    wanted = list(dict.fromkeys([*spec.keys, target, *columns]))
    # written once: extremes, means, known columns and both tables go over it
    split = staged(modeling.chronological_split(rows.select(*wanted), spec, TEST_SHARE), "split")
    fit = F.col("is_train") if fit_on == "train" else None
    matrix = modeling.model_matrix(split, columns, target, [*spec.keys, "is_train"], fit_rows=fit)
    if site_effect:
        means = matrix.where("is_train").groupBy(*spec.site).agg(F.avg(target).alias(SITE_EFFECT))
        matrix = impute.mean_fill(match(matrix, means, spec.site, "left"), [SITE_EFFECT], matrix.where("is_train").select(F.col(target).alias(SITE_EFFECT)))
        columns = [*columns, SITE_EFFECT]
    # after the fill a column is null where it had no mean to take
    used = modeling.known_columns(matrix if fit is None else matrix.where("is_train"), [c for c in columns if c in matrix.columns])
    return matrix.select(*dict.fromkeys([*spec.keys, "is_train", target, *used])), used


def site_matrix(
    features: DataFrame, spec: SeriesSpec, columns: Sequence[str], target: str, focus_inversion: bool, fit_on: str = "train", site_effect: bool = False
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test tables with ``features`` and ``label``, and the names behind ``features``."""
    matrix, used = training_matrix(features, spec, columns, target, focus_inversion, fit_on, site_effect)
    known = ml.assemble(matrix, used, target)
    return known.where("is_train"), known.where(~F.col("is_train")), used


def _forecast_one(
    rows: DataFrame, spec: SeriesSpec, target: str, label: str, name: str, columns: Sequence[str] | None, focus_inversion: bool,
    sizes: tuple, pooled: bool, models_to: str | None,
) -> tuple[DataFrame, list[tuple]]:
    """Predictions of one site (or all together) and target, and each model's importance rows."""
    candidates = rows if columns is None else rows.select(*columns)
    chosen = filters.select_features(candidates, ids=(*filters.ID_COLUMNS, *spec.keys))
    train, test, used = site_matrix(rows, spec, chosen, target, focus_inversion, site_effect=pooled)
    table = [*spec.keys, "features", "label"]
    # written once: many fits read it
    train, test = staged(train.select(*table), "train"), staged(test.select(*table), "test")
    if train.isEmpty():
        raise ValueError(f"no training rows with a known {target}")
    fitted, predictions = ml.train_all(train, test, spec, *sizes)
    importance = [
        (name, label, kind, feature, float(value))
        for kind, model in fitted.items()
        if hasattr(model, "featureImportances")
        for feature, value in zip(used, model.featureImportances.toArray())
    ]
    if models_to is not None:
        for kind, model in fitted.items():
            sinks.save_model(model, f"{models_to}/{name}/{label}/{kind}")
    shown = predictions.select(F.col(spec.site[0]).alias("site"), F.lit(label).alias("target"), "model", *spec.order, "label", "prediction")
    return staged(shown, "predictions"), importance


def forecast_job(
    features: DataFrame,
    spec: SeriesSpec = STATION,
    targets: dict[str, str] | None = None,
    focus_inversion: bool = True,
    rounds: int = 200,
    depth: int = 6,
    folds: int = 5,
    stack: bool = True,
    columns: Sequence[str] | None = None,
    sites: Sequence[str] | None = None,
    workers: int = 4,
    models_to: str | None = None,
) -> dict[str, DataFrame]:
    """Split, fit the boosted variants and their stack, score, pick the best, per site and target.

    One set of models per target for all sites, with the site's mean as a feature; with ``sites``
    each one listed gets models of its own, several sites at a time. ``importance`` has every
    model's features, ``failures`` what could not be fitted. ``models_to``: folder for the models."""
    spark, site = features.sparkSession, spec.site[0]
    wanted = {label: target for label, target in (targets or FORECAST_TARGETS).items() if target in features.columns}
    if columns is not None:  # of a table of hundreds of columns only those that are read are written
        features = features.select(*existing(features, dict.fromkeys([*spec.keys, *wanted.values(), *columns, *filters.INDICATORS])))
    table = staged(features, "features")
    groups = {POOLED: table} if sites is None else {name: filters.site_rows(table, site, name) for name in dict.fromkeys(sites)}
    tasks = {
        (name, label): partial(
            _forecast_one, rows, spec, target, label, name, columns, focus_inversion, (rounds, depth, folds, stack), sites is None, models_to
        )
        for name, rows in groups.items()
        for label, target in wanted.items()
    }
    done, failed = side_by_side(spark, tasks, workers)
    importance = spark.createDataFrame([r for _, rows in done.values() for r in rows], "site string, target string, model string, feature string, importance double")
    failures = spark.createDataFrame(failed, "site string, target string, error string")
    if not done:
        order = [f for f in table.schema.fields if f.name in spec.order]
        kinds = ["site string", "target string", "model string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in order], "label double", "prediction double"]
        predictions = spark.createDataFrame([], ", ".join(kinds))
    else:
        predictions = reduce(DataFrame.unionByName, [p for p, _ in done.values()])
    results = modeling.scores(predictions, ["site", "target", "model"])
    return {
        "predictions": predictions,
        "results": results,
        "best": modeling.best_models(results),
        "importance": importance,
        "failures": failures,
    }


def explain_site(
    df: DataFrame,
    spec: SeriesSpec,
    target: str,
    columns: Sequence[str],
    trees: int = 100,
    depth: int = 10,
    repeats: int = 10,
    max_samples: int | None = None,
    permutations: int = 20,
) -> dict[str, DataFrame]:
    """Forest, its impurity, permutation and Shapley importance, their comparison and scores.
    All rows are explained, or a sample of ``max_samples``."""
    times = model_time_columns(df, spec.ts)
    rows = df.where(F.col(target).isNotNull()).withColumns(times)
    used = list(dict.fromkeys([*columns, *times]))
    # written once each: limits, cuts, known columns and means go over them
    filled = staged(impute.fill_all(rows, spec, used).select(*dict.fromkeys([*spec.keys, target, *used])), "filled")
    split = staged(modeling.chronological_split(filters.drop_outliers(filled, target), spec, TEST_SHARE), "split")
    # what a whole site lacks is the mean of the other sites; what all lack is left out
    used = modeling.known_columns(split.where("is_train"), used)
    split = impute.mean_fill(split, used, split.where("is_train"))
    table = ml.assemble(split.select(*spec.keys, "is_train", target, *[c for c in used if c != target]), used, target)
    # written once: the fit and three explanations read it
    table = staged(table.select(*spec.keys, "is_train", "features", "label"), "explained")
    train, test = table.where("is_train"), table.where(~F.col("is_train"))
    model = ml.fit_forest(train.select("features", "label"), trees, depth)
    impurity = ml.importance_table(model, used, train)
    permuted = ml.permutation_importance(model.transform, test, used, spec.keys, repeats)
    forest = staged(impurity.join(permuted, "feature"), "importance")
    sample = table if max_samples is None else modeling.sample_rows(table, spec.keys, max_samples)
    phi = staged(ml.shapley_values(model.transform, sample, table, used, spec.keys, permutations), "phi")
    shapley = ml.shapley_importance(phi)
    comparison = staged(modeling.compare_methods(forest, shapley), "comparison")
    return {
        "scores": staged(model.transform(test).agg(*modeling.score_columns()), "scores"),
        "forest": forest,
        "phi": phi,
        "shapley": shapley,
        "spread": ml.shapley_spread(phi),
        "comparison": comparison,
        "rank_correlation": modeling.rank_correlation(comparison, "rf_rank", "shap_rank"),
        "rank_correlation_top15": modeling.rank_correlation(comparison.orderBy("avg_rank", "rf_rank").limit(15), "rf_rank", "shap_rank"),
    }


def significance_job(
    df: DataFrame,
    spec: SeriesSpec = STATION,
    targets: Sequence[str] = ("TAIR_VT20", "VT90_VT20"),
    more_than: int = 100,
    exclude_inputs: bool = False,
    pooled: bool = True,
    k: int = 10,
    sites: Sequence[str] = (),
    workers: int = 2,
    **sizes,
) -> dict[str, DataFrame]:
    """Targets, profile, then per target all sites together and each of ``sites`` that has more than
    ``more_than`` rows: forest, permutation and Shapley importance; the top features of every
    method in one report, and beside it scores, comparison, spread, rank correlations, failures."""
    spark, site = df.sparkSession, spec.site[0]
    table = staged(filters.difference_targets(df), "significance")
    asked = table.where(F.col(site).isin(list(sites))) if sites else table.limit(0)
    names = [r[0] for r in filters.large_sites(asked, spec.site, more_than).select(site).distinct().orderBy(site).collect()]
    skip = {"TAIR", "VT20", "VT90", "TAIR_VT20", "VT90_VT20"} if exclude_inputs else set()
    groups = {name: filters.site_rows(table, site, name) for name in names} | ({COMBINED: table} if pooled else {})
    tasks = {}
    for target in targets:
        columns = [c for c in filters.all_but(table, target, (*filters.ID_COLUMNS, *spec.keys)) if c not in skip]
        tasks |= {(name, target): partial(explain_site, rows, spec, target, columns, **sizes) for name, rows in groups.items()}
    done, failed = side_by_side(spark, tasks, workers)
    failures = spark.createDataFrame(failed, "site string, target string, error string")
    out: dict[str, list[DataFrame]] = {}
    for (name, target), found in done.items():
        methods = {
            m: found[t].select(F.lit(name).alias("site"), "feature", F.col(c).alias("score"))
            for m, t, c in (("impurity", "forest", "importance"), ("permutation", "forest", "perm_importance_mean"), ("shapley", "shapley", "shap_importance"))
        }
        out.setdefault("report", []).append(modeling.significance_report(methods, k).withColumn("target", F.lit(target)))
        explained = found["phi"].groupBy("feature").agg(F.count("*").alias("rows")).agg(F.max("rows").alias("explained_rows"))
        out.setdefault("explained", []).append(explained.withColumns({"site": F.lit(name), "target": F.lit(target)}))
        for part in ("scores", "comparison", "spread", "rank_correlation", "rank_correlation_top15"):
            out.setdefault(part, []).append(found[part].withColumns({"site": F.lit(name), "target": F.lit(target)}))
    if not done:
        raise ValueError(f"nothing could be explained: {failed or 'no site is large enough'}")
    profile = quality.dataset_profile(table, site, spec.ts, list(targets))
    return {"profile": profile, "failures": failures, **{part: reduce(DataFrame.unionByName, tables) for part, tables in out.items()}}


def convert_rasters(
    spark: SparkSession,
    path: str,
    grid: DataFrame | None = None,
    out: str | None = None,
    variable: str | None = None,
    years: Sequence[int] | None = None,
    pattern: str | None = None,
    region: dict | None = filters.REGION,
    every: int = 1,
) -> dict[str, DataFrame]:
    """Grid files to point tables: window, subsample, altitude, key, partitioned output. A file
    that cannot be read is reported and does not stop the others."""
    files = raster.list_rasters(spark, path).withColumn("year", F.year("date"))
    if variable is not None:
        files = files.where(F.coalesce(F.col("variable") == variable, F.lit(True)))
    files = wanted_files(files, years, pattern)
    # decoded once: the key, the report and the list of failures all go over the cells again
    cells = staged(raster.decode_rasters(files, region, every), "cells")
    good = cells.where(F.col("error").isNull()).drop("error")
    if grid is not None:
        # files of one geometry share their cells: each place is looked up once
        places = spatial.add_altitude(good.select("longitude", "latitude").distinct(), grid)
        good = good.join(places, ["longitude", "latitude"], "left")
    points = filters.point_columns(good, SeriesSpec(("name",), "pixel")).select("*", F.year("timestamp").alias("year"))
    if out is not None:
        sinks.write_points(points.drop("year"), out)
    failures = cells.where(F.col("error").isNotNull()).select("name", "error").distinct()
    return {"points": points, "failures": failures, "report": run_report(files, cells)}


def wanted_files(files: DataFrame, years: Sequence[int] | None, pattern: str | None) -> DataFrame:
    """Files of the wanted years and name; unreadable names stay in so that they are reported."""
    out = files
    if years is not None:
        out = out.where(F.col("year").isNull() | F.col("year").isin(*years))
    if pattern is not None:
        out = out.where(F.col("name").contains(pattern))
    return out


def run_report(files: DataFrame, cells: DataFrame) -> DataFrame:
    """Per year: files seen, files that failed, points."""
    per_file = cells.groupBy("name").agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("points"), F.max("error").alias("error")
    )
    listed = files.select("name", "year")
    return (
        listed.join(per_file, "name", "left")
        .groupBy("year")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count("error").alias("failed"),
            F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        )
    )


def enrich_points(
    spark: SparkSession, path: str, grid: DataFrame, out: str, fmt: str = "csv", lat: str = "latitude", lon: str = "longitude"
) -> DataFrame:
    """Altitude for existing point tables, written to a new path."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    points = reader.format(fmt).load(path)
    typed = points.withColumns({c: F.col(c).try_cast("double") for c in (lat, lon)})
    enriched = spatial.add_altitude(typed, grid, lat, lon)
    sinks.write_table(enriched, out, fmt)
    return enriched
