"""Model jobs with a model of its own for every site, grown together: no list of sites, no loop over
them, and as many Spark jobs for a thousand sites as for one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.functions.calendar import cyclic_columns
from inversia.functions.coercion import existing, number
from inversia.operators import filters, grouped_trees, impute_ml, modeling, small_groups
from inversia.operators.grouped_trees import Growth
from inversia.operators.impute import SENSORS
from inversia.operators.windows import add_lags
from inversia.plans.jobs import FORECAST_TARGETS, STATION, TEST_SHARE
from inversia.plans.joins import match
from inversia.plans.series import SeriesSpec
from inversia.session import staged

STACKED = "stacked"
#: The penalty that a booster of each kind puts on leaves by default (fixed values).
ROW_COLUMN_L2, COLUMN_L2, FULL_L2 = 1.0, 0.0, 3.0
FILL_FOREST, FILL_BOOSTED = "random_forest", "gradient_boosting"


def variants(growth: Growth = Growth()) -> dict[str, Growth]:
    """Draws of rows and columns, of columns only, and none."""
    return {
        "gbt_row_col": replace(growth, rows=0.8, columns=0.8, l2=ROW_COLUMN_L2),
        "gbt_col": replace(growth, columns=0.8, l2=COLUMN_L2),
        "gbt_full": replace(growth, l2=FULL_L2),
    }


def _mean_filled(rows: DataFrame, group: Sequence[str], columns: Sequence[str], learn: Column) -> DataFrame:
    """Null, NaN and infinite cells take the mean of their group's training rows."""
    value = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    means = rows.where(learn).groupBy(*group).agg(*[F.avg(v).alias(f"_mean_{c}") for c, v in value.items()])
    joined = match(rows, staged(means, "means"), list(group), "left")
    return joined.withColumns({c: F.coalesce(v, F.col(f"_mean_{c}")) for c, v in value.items()}).drop(*[f"_mean_{c}" for c in columns])


def _stacked_weights(held: DataFrame, group: Sequence[str], bases: Sequence[str]) -> DataFrame:
    """Group columns and ``_w``: intercept and weights of the least-squares line through out-of-fold
    predictions. A group sends sums of products; equations without one solution take the shortest."""
    terms = [F.lit(1.0), *[F.col(b) for b in bases]]
    n = len(terms)
    sums = [F.sum(a * b) for a in terms for b in terms] + [F.sum(a * F.col("label")) for a in terms]
    gathered = held.groupBy(*group).agg(F.array(*sums).alias("_s"))

    @F.pandas_udf("array<double>")
    def solved(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.linalg.lstsq(np.reshape(x[: n * n], (n, n)), x[n * n :], rcond=1e-12)[0])

    return gathered.select(*group, solved("_s").alias("_w"))


def _small_fits(stacked: DataFrame, spec: SeriesSpec, columns: Sequence[str], growth: Growth, folds: int) -> DataFrame:
    """Rows with what their group's models say of them, and the models' importance, see ``fit_folds``.
    Rows are shuffled once: the split's windows need them by group, as the fits do."""
    group = [*spec.site, "target"]
    # a group fits a task, so none is cut
    series = spec.but(site=tuple(group), rows_per_chunk=max(spec.rows_per_chunk, grouped_trees.MOST_CELLS))
    split = modeling.chronological_split(stacked.repartition(*group), series, TEST_SHARE, folds=folds)
    split = split if folds else split.withColumn("fold", F.lit(None).cast("int"))
    growths = {f"_p_{name}": sizes for name, sizes in variants(growth).items()}
    return small_groups.fit_folds(split.sortWithinPartitions(*group), group, spec.order, columns, spec.keys, range(-1, folds), growths)


def _large_fits(stacked: DataFrame, spec: SeriesSpec, columns: Sequence[str], growth: Growth, folds: int) -> DataFrame:
    """As ``_small_fits``, of groups that no task holds: a row is a row of every fold's model."""
    group = [*spec.site, "target"]
    split = staged(modeling.chronological_split(stacked, spec.but(site=tuple(group)), TEST_SHARE, folds=folds), "split")
    split = split if folds else split.withColumn("fold", F.lit(None).cast("int"))
    split = _mean_filled(split, group, columns, F.col("is_train"))
    every = F.when(F.col("is_train"), F.sequence(F.lit(-1), F.lit(folds - 1)) if folds else F.array(F.lit(-1))).otherwise(F.array(F.lit(-1)))
    table = staged(split.withColumn("_fold", F.explode(every)), "folds")
    learn = F.col("is_train") & ~F.col("fold").eqNullSafe(F.col("_fold"))
    growths = {f"_p_{name}": sizes for name, sizes in variants(growth).items()}
    models, table = grouped_trees.fit_variants(table, [*group, "_fold"], columns, "label", spec.keys, learn, growths)
    table = table.where("NOT is_train OR _fold = fold").select(*group, *spec.order, "label", "is_train", "fold", *growths, F.lit(None).cast("array<double>").alias("shares"))
    shares = None
    for name, model in models.items():
        by = model.importance().where("_fold = -1").groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("by"))
        mine = by.select(*group, F.array(*[F.element_at("by", F.lit(c)) for c in columns]).alias(name))
        shares = mine if shares is None else match(shares, mine, group)
    shares = shares.select(*group, F.concat(*growths).alias("shares"))
    return table.unionByName(shares, allowMissingColumns=True)


def forecast_all_sites(
    features: DataFrame,
    spec: SeriesSpec = STATION,
    targets: dict[str, str] | None = None,
    columns: Sequence[str] | None = None,
    focus_inversion: bool = True,
    growth: Growth = Growth(),
    folds: int = 5,
    stack: bool = True,
) -> dict[str, DataFrame]:
    """The forecast job with models of their own for every site and target.

    Per site and target: the first 80 % of the rows train, null features take the training mean, the
    three boosted variants are fitted on all training rows and on all folds but one, and a linear
    model learns from the out-of-fold predictions. ``predictions`` (of the test rows), ``results``,
    ``best`` and ``importance`` as in ``forecast_job``; a site without training rows has no
    predictions. Sites and targets of up to ``MOST_CELLS`` cells are fitted whole where their rows are
    (``small_groups``); of larger ones, targets and folds are groups of the same fits."""
    site = spec.site[0]
    rows = filters.inversion_rows(features) if focus_inversion else features
    wanted = {label: target for label, target in (targets or FORECAST_TARGETS).items() if target in rows.columns}
    if columns is None:
        columns = filters.select_features(rows, ids=(*filters.ID_COLUMNS, *spec.keys))
    columns = [c for c in columns if c not in spec.keys]
    target = F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.col(c).cast("double").alias("label")) for n, c in wanted.items()]))
    # written once: sizes, lengths and splits go over it
    rows = staged(rows.select(*dict.fromkeys([*spec.keys, *columns, *wanted.values()])), "rows")
    stacked = rows.select(*spec.keys, *columns, target.alias("_t")).select(*spec.keys, *columns, "_t.target", "_t.label").where("label IS NOT NULL")
    group, bases = [*spec.site, "target"], [f"_p_{name}" for name in variants(growth)]
    sizes = stacked.groupBy(*group).agg((F.count("*") * len(columns) > grouped_trees.MOST_CELLS).alias("_large"))
    large = staged(sizes.where("_large"), "large")  # few: each has a million cells
    parts = []
    if large.isEmpty():
        parts.append(_small_fits(stacked, spec, columns, growth, folds if stack else 0))
    else:
        told = match(stacked, F.broadcast(large), group, "left")
        parts.append(_small_fits(told.where("_large IS NULL").drop("_large"), spec, columns, growth, folds if stack else 0))
        parts.append(_large_fits(told.where("_large").drop("_large"), spec, columns, growth, folds if stack else 0))
    # training rows are of use to the stack only, which asks for no time
    kept = [F.when(~F.col("is_train"), F.col(c)).alias(c) for c in spec.order]
    fitted = staged(reduce(DataFrame.unionByName, parts).where("shares IS NOT NULL OR NOT is_train OR fold IS NOT NULL").select(*group, *kept, "label", "is_train", "fold", *bases, "shares"), "fitted")
    shares = fitted.where("shares IS NOT NULL").select(F.col(site).alias("site"), "target", "shares")
    named = F.array(*[F.struct(F.lit(b[3:]).alias("model"), F.lit(c).alias("feature")) for b in bases for c in columns])
    out = shares.select("site", "target", F.inline(F.arrays_zip(named.alias("of"), F.col("shares").alias("importance")))).select("site", "target", "of.model", "of.feature", "importance")
    tested = fitted.where("NOT is_train")
    if stack:
        weights = staged(_stacked_weights(fitted.where("is_train"), group, bases), "weights")
        tested = match(tested, weights, group, "left")
        line = sum((F.col("_w")[i + 1] * F.col(b) for i, b in enumerate(bases)), F.col("_w")[0])
        tested = tested.withColumn(f"_p_{STACKED}", line)
        bases.append(f"_p_{STACKED}")
    shown = F.explode(F.array(*[F.struct(F.lit(b[3:]).alias("model"), F.col(b).alias("prediction")) for b in bases]))
    predictions = tested.select(F.col(site).alias("site"), "target", *spec.order, "label", shown.alias("_m")).select("site", "target", "_m.model", *spec.order, "label", "_m.prediction")
    predictions = staged(predictions.where("prediction IS NOT NULL"), "predictions")
    results = modeling.scores(predictions, ["site", "target", "model"])
    return {"predictions": predictions, "results": results, "best": modeling.best_models(results), "importance": out}


def fill_all_sites(
    df: DataFrame,
    spec: SeriesSpec = STATION,
    variables: Sequence[str] | None = None,
    method: str = FILL_BOOSTED,
    growth: Growth | None = None,
    trees: int = 100,
    sensors: Sequence[str] = SENSORS,
) -> DataFrame:
    """Null sensors filled by models of their own for every site.

    Variables are filled in order, and a model sees the fills before it. Features are the other
    sensors as far as they read as numbers and the time of day and year; the boosted model also has
    lags 1 and 2 of the first three, and neither learns from nor fills rows with under 70 % of its
    features known. A site with no known value of a variable keeps its nulls. Only keys and the
    filled column of each variable are written between fits."""
    if method not in (FILL_FOREST, FILL_BOOSTED):
        raise ValueError(f"unknown method {method}")
    wanted = existing(df, variables if variables is not None else sensors)
    order = df.columns
    df = df.withColumns({c: number(F.col(c)) for c in wanted}) if wanted else df
    for variable in wanted:
        others = impute_ml.feature_sensors(df, variable, sensors)
        clock = cyclic_columns(F.col(spec.ts), day="day")
        rows = df.withColumns({**{f"_n_{c}": number(F.col(c)) for c in others}, **{f"_t_{n}": c for n, c in clock.items()}})
        usable = F.lit(True)
        if method == FILL_BOOSTED:
            rows = add_lags(rows, spec, [f"_n_{c}" for c in others[:3]], (1, 2))
        names = [c for c in rows.columns if c.startswith(("_n_", "_t_"))]
        if method == FILL_BOOSTED:
            known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
            usable = known >= int(0.7 * len(names))
        rows = rows.withColumn("_use", usable)
        if method == FILL_FOREST:
            _, out = grouped_trees.fit_forests(rows, spec.site, names, variable, spec.keys, F.col("_use"), trees, growth or Growth(depth=10, least=2.0, l2=0.0))
        else:
            _, out = grouped_trees.fit_boosted(rows, spec.site, names, variable, spec.keys, F.col("_use"), growth or Growth(depth=5))
        filled = F.coalesce(F.col(variable), F.when(F.col("_use"), F.col("prediction")))
        df = out.select(*[filled.alias(c) if c == variable else F.col(c) for c in order])
    return df.select(*order)


def importance_all_sites(
    df: DataFrame, spec: SeriesSpec, target: str, columns: Sequence[str], trees: int = 100, growth: Growth = Growth(depth=10, least=2.0, l2=0.0)
) -> tuple[DataFrame, DataFrame]:
    """Forest importance of ``columns`` for ``target`` and the held-out scores, for every site: site,
    feature, importance, rank; and site, rmse, mae, r2 of the last 20 % of its rows."""
    rows = df.where(F.col(target).isNotNull()).select(*dict.fromkeys([*spec.keys, target, *columns]))
    split = staged(modeling.chronological_split(rows, spec, TEST_SHARE), "split")
    split = _mean_filled(split, spec.site, [c for c in columns if c != target], F.col("is_train"))
    model, out = grouped_trees.fit_forests(split, spec.site, columns, target, spec.keys, F.col("is_train"), trees, growth)
    site = F.col(spec.site[0]).alias("site")
    ranked = modeling.ranked(model.importance().select(site, "feature", "importance"), "importance", "rank", ["site"])
    return ranked, modeling.scores(out.where("NOT is_train").select(site, F.col(target).alias("label"), "prediction"), ["site"])
