"""Invariants of model fills, importance, Shapley values, stacking and the model jobs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inversia.operators import impute_ml, ml, modeling
from inversia.plans import jobs
from inversia.plans.series import SeriesSpec
from tests.helpers import SPEC, START, series, values

SMALL = impute_ml.FillModels(trees=8, tree_depth=4, rounds=5)
SENSORS = ("TAIR", "DWPT", "PRES")


def weather_table(spark, rows=200, hole=20, sites=("A",)):
    import datetime as dt

    rng = random.Random(3)
    data = []
    for site in sites:
        for i in range(rows):
            dwpt, pres = 10 * math.sin(i / 12), 1000 + rng.uniform(-5, 5)
            tair = None if 50 <= i < 50 + hole else 2 * dwpt + rng.uniform(-0.1, 0.1)
            data.append((site, START + dt.timedelta(minutes=30 * i), i, tair, dwpt, None if i % 9 == 0 else pres))
    return spark.createDataFrame(data, "site string, ts timestamp_ntz, id bigint, TAIR double, DWPT double, PRES double")


def linear_scorer(weights):
    from pyspark.ml.functions import vector_to_array

    def score(rows):
        x = vector_to_array("features")
        return rows.withColumn("prediction", sum((x[i] * w for i, w in enumerate(weights)), F.lit(1.0)))

    return score


def test_model_fills_keep_known_cells(spark):
    df = weather_table(spark)
    for fill in (impute_ml.forest_fill, impute_ml.boosted_fill):
        out = fill(df, SPEC, "TAIR", SMALL, SENSORS)
        both = df.select("id", "TAIR").join(out.select("id", F.col("TAIR").alias("f"), "DWPT"), "id")
        assert both.where(F.col("TAIR").isNotNull() & (F.col("TAIR") != F.col("f"))).count() == 0
        assert both.where(F.col("f").isNull()).count() == 0
        error = both.where(F.col("TAIR").isNull()).agg(F.avg(F.abs(F.col("f") - 2 * F.col("DWPT")))).first()[0]
        assert error < 6


def test_boosted_fill_leaves_rows_without_features(spark):
    df = weather_table(spark).withColumns({c: F.when(F.col("id") != 55, F.col(c)) for c in ("DWPT", "PRES")})
    df = df.withColumns({f"S{i}": F.when(F.col("id") != 55, F.col("id") * 1.0) for i in range(8)})
    out = impute_ml.boosted_fill(df, SPEC, "TAIR", SMALL, (*SENSORS, *[f"S{i}" for i in range(8)]))
    assert [r.id for r in out.where(F.col("TAIR").isNull()).collect()] == [55]


def test_fallbacks(spark):
    lonely = series(spark, [1, None, 3], names="TAIR")
    assert values(impute_ml.boosted_fill(lonely, SPEC, "TAIR", SMALL), "TAIR") == [1, 2, 3]
    assert values(impute_ml.forest_fill(lonely, SPEC, "TAIR", SMALL), "TAIR") == [1, None, 3]


def test_policy(spark):
    def holes(n):
        return [1.0] * 10 + [None] * n + [2.0] * (70 - n)

    df = series(spark, holes(0), holes(12), holes(13), holes(49), holes(60), names="TAIR,DWPT,PRES,RELH,PRCP")
    names = ["TAIR", "DWPT", "PRES", "RELH", "PRCP"]
    assert impute_ml.choose_methods(df, SPEC, names) == {
        "DWPT": "linear", "PRES": "random_forest", "RELH": "gradient_boosting", "PRCP": "gradient_boosting"
    }
    assert impute_ml.choose_methods(df, SPEC, names, type_aware=True)["PRCP"] == "zero"


def test_auto_fill_sees_earlier_fills_only(spark):
    df = weather_table(spark, hole=20).withColumn("DWPT", F.when(~F.col("id").isin(20, 21), F.col("DWPT")))
    filled, report, failures = jobs.fill_job(df, SPEC, "auto", SMALL, variables=SENSORS)
    assert failures.count() == 0
    assert filled.columns == df.columns
    assert filled.where(" or ".join(f"{c} is null" for c in SENSORS)).count() == 0
    rows = {r.variable: r for r in report.collect()}
    assert rows["TAIR"].filled == 20 and rows["DWPT"].current_missing == 0
    assert values(jobs.fill_job(df, SPEC, "linear", variables=["DWPT"])[0].where("id in (20, 21)"), "DWPT") == pytest.approx(
        [10 * math.sin(19 / 12) + (10 * math.sin(22 / 12) - 10 * math.sin(19 / 12)) * k / 3 for k in (1, 2)], abs=1e-5
    )


def test_hidden_cells_are_scored(spark):
    got = impute_ml.evaluate_fill(weather_table(spark, hole=0), SPEC, "TAIR", method="linear", sensors=SENSORS).first()
    assert 5 <= got.n_test_points <= 45 and got.n_filled == got.n_test_points
    assert got.r2 > 0.9 and got.rmse >= got.mae > 0


def test_permutation_importance(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(0, 1), 5.0, rng.uniform(0, 1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>")
    df = df.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))
    table = ml.assemble(df.withColumn("y", 1 + 3 * F.col("a") + F.col("b")), ["a", "b", "c"], "y").select("id", "features", "label")
    both = []
    for per in (10**6, 50):
        got = ml.permutation_importance(linear_scorer([3, 1, 0]), table, ["a", "b", "c"], ["id"], 3, rows_per_task=per)
        found = {r.feature: r for r in got.collect()}
        both.append({f: round(r.perm_importance_mean, 9) for f, r in found.items()})
        assert found["a"].perm_importance_mean > 1.0
        assert found["b"].perm_importance_mean == pytest.approx(0) and found["c"].perm_importance_std == pytest.approx(0)
    assert both[0] == both[1]


def test_shapley_is_exact_for_a_linear_model(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, -1.0, 0.0, 5.0)], "id int, a double, b double, c double").withColumn("y", F.lit(0.0))
    rows = ml.assemble(df, ["a", "b", "c"], "y")
    one = ml.assemble(spark.createDataFrame([(9, 0.5, 0.5, 0.5)], "id int, a double, b double, c double").withColumn("y", F.lit(0.0)), ["a", "b", "c"], "y")
    phi = ml.shapley_values(linear_scorer([2, -1, 0.5]), rows, one, ["a", "b", "c"], ["id"], permutations=4)
    got = {(r.id, r.feature): round(r.phi, 9) for r in phi.collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): -1.5, (1, "c"): 1.25, (2, "a"): -3.0, (2, "b"): 0.5, (2, "c"): 2.25}
    first = ml.explain_row(phi, F.col("id") == 2).collect()
    assert [r.feature for r in first] == ["a", "c", "b"]
    spread = {r.feature: (r.low, r.median, r.high) for r in ml.shapley_spread(phi).collect()}
    assert spread["a"] == pytest.approx((-3.0, -1.0, 1.0))
    mean = {r.feature: r.shap_importance for r in ml.shapley_importance(phi).collect()}
    assert mean["a"] == pytest.approx(2.0)


def test_stacked_model(spark):
    df = weather_table(spark, hole=0).na.drop()
    table = ml.assemble(df, ["DWPT", "PRES"], "TAIR").select("site", "ts", "id", "features", "label")
    split = modeling.chronological_split(table, SPEC)
    models, predictions = ml.train_all(split.where("is_train"), split.where("not is_train"), SPEC, rounds=2, depth=2, folds=2)
    assert set(models) == {"gbt_row_col", "gbt_col", "gbt_full", "stacked"}
    got = {r.model: r for r in ml.evaluate(predictions).collect()}
    assert len(got) == 4 and all(r.rmse >= r.mae for r in got.values())
    forest = ml.fit_forest(split.where("is_train"), trees=5, depth=3)
    importance = ml.importance_table(forest, ["DWPT", "PRES"], table).collect()
    assert importance[0].feature == "DWPT" and sum(r.importance for r in importance) == pytest.approx(1)


def two_sites(spark, rows=120):
    return weather_table(spark, rows=rows, hole=0, sites=("A", "B")).withColumns({"VT05": F.lit(0.0), "VT20": F.col("DWPT"), "VT90": F.col("DWPT") + 1})


FORECAST = {"rounds": 2, "depth": 2, "stack": False, "columns": ["VT20", "VT20_lag_1", "PRES"]}


def test_forecast_job(spark, tmp_path):
    features = jobs.build_features(two_sites(spark), SPEC)
    pooled = jobs.forecast_job(features, SPEC, {"VT20": "VT20_target_1h"}, **FORECAST)
    apart = jobs.forecast_job(features, SPEC, {"VT20": "VT20_target_1h"}, sites=["A", "B"], models_to=f"{tmp_path}/models", **FORECAST)
    for found in (pooled, apart):
        results = found["results"].collect()
        assert len(results) == 6 and {r.site for r in results} == {"A", "B"}
        assert found["best"].count() == 2 and found["failures"].count() == 0
    assert {(r.site, r.feature) for r in pooled["importance"].collect()} == {("all", f) for f in ("VT20", "VT20_lag_1", "PRES", "site_mean")}
    assert {r.site for r in apart["importance"].collect()} == {"A", "B"}
    from pyspark.ml.regression import GBTRegressionModel

    again = GBTRegressionModel.load(f"{tmp_path}/models/A/VT20/gbt_full")
    assert again.getNumTrees == 2


def test_a_site_that_cannot_be_fitted_is_reported(spark):
    """B has lost its target, C does not exist; A is forecast all the same."""
    features = jobs.build_features(two_sites(spark), SPEC).withColumn("VT20_target_1h", F.when(F.col("site") == "A", F.col("VT20_target_1h")))
    found = jobs.forecast_job(features, SPEC, {"VT20": "VT20_target_1h"}, sites=["A", "B", "C"], **FORECAST)
    assert {r.site for r in found["results"].collect()} == {"A"}
    assert {(r.site, r.target) for r in found["failures"].collect()} == {("B", "VT20"), ("C", "VT20")}
    none = jobs.forecast_job(features, SPEC, {"VT20": "VT20_target_1h"}, sites=["B"], **FORECAST)
    assert none["results"].count() == 0 and none["failures"].count() == 1 and none["importance"].count() == 0


def test_training_keeps_rows_and_drops_unknown_columns(spark):
    features = two_sites(spark).withColumns(
        {"PRES": F.when(F.col("site") == "A", F.col("PRES")), "SRAD": F.lit(None).cast("double"), "VT_inversion_90_20": F.lit(1.0)}
    )
    matrix, used = jobs.training_matrix(features, SPEC, ["PRES", "DWPT", "SRAD"], "VT20", False)
    assert used == ["PRES", "DWPT"] and matrix.count() == 240
    assert matrix.where("PRES is null").count() == 0


def test_explained_rows_include_sites_without_a_sensor(spark):
    df = two_sites(spark, 110).withColumns({"PRES": F.when(F.col("site") == "A", F.col("PRES")), "VT90": F.col("DWPT") + F.col("id") % 5})
    found = jobs.significance_job(
        df, SPEC, ["TAIR_VT20"], exclude_inputs=True, k=3, sites=["A", "B", "C"], more_than=100, trees=3, depth=3, repeats=1, permutations=1
    )
    assert {(r.site, r.explained_rows) for r in found["explained"].collect()} == {("A", 110), ("B", 110), ("combined", 220)}
    assert found["failures"].count() == 0 and found["rank_correlation"].count() == 3 and found["scores"].count() == 3


def test_significance_job(spark):
    df = weather_table(spark, rows=130, hole=0, sites=("A", "B")).withColumns({"VT20": F.col("DWPT"), "VT90": F.col("DWPT") + F.col("id") % 5})
    found = jobs.significance_job(
        df, SPEC, ["TAIR_VT20"], exclude_inputs=True, k=3, sites=["A"], pooled=False, trees=4, depth=3, repeats=2, max_samples=20, permutations=2
    )
    report = found["report"].collect()
    assert {(r.method, r.site) for r in report} == {("impurity", "A"), ("permutation", "A"), ("shapley", "A")}
    assert len(report) == 9 and found["comparison"].count() == 7
    assert found["profile"].first().sites == 2 and found["explained"].first().explained_rows == 20


def test_site_fills_leave_other_sites(spark):
    df = weather_table(spark, sites=("A", "B"))
    filled, _, failures = jobs.fill_job(df, SPEC, "random_forest", SMALL, sites=["B", "nowhere"], variables=["TAIR"])
    left = {r.site: r.n for r in filled.groupBy("site").agg(F.count(F.when(F.col("TAIR").isNull(), 1)).alias("n")).collect()}
    assert left == {"A": 20, "B": 0} and filled.columns == df.columns and failures.count() == 0


def test_unknown_method_is_refused(spark):
    with pytest.raises(ValueError, match="unknown method"):
        impute_ml.fill_gaps(series(spark, [1, None], names="TAIR"), SPEC, "magic")


def test_spark_errors_fall_back_to_the_linear_fill(spark):
    df = series(spark, [1.0, None, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], names="TAIR,DWPT")
    broken = impute_ml.FillModels(trees=0)
    assert values(impute_ml.forest_fill(df, SPEC, "TAIR", broken), "TAIR") == [1, 2, 3, 4]


def test_shapley_values_of_repeated_keys_stay_apart(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 5.0)], "id int, a double").withColumn("y", F.lit(0.0))
    zero = spark.createDataFrame([(9, 0.0)], "id int, a double").withColumn("y", F.lit(0.0))
    phi = ml.shapley_values(linear_scorer([2]), ml.assemble(rows, ["a"], "y"), ml.assemble(zero, ["a"], "y"), ["a"], ["id"], 3)
    assert sorted(r.phi for r in phi.collect()) == [2.0, 10.0]


def test_shapley_draws_come_from_the_whole_background(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(40)], "id int, a double").withColumn("y", F.lit(0.0))
    table = ml.assemble(rows, ["a"], "y")
    seen = set()
    for per in (100, 7):
        phi = ml.shapley_values(linear_scorer([1]), table, table, ["a"], ["id"], 1, rows_per_task=per).collect()
        assert len(phi) == 40
        seen.add(tuple(sorted((r.id, r.phi) for r in phi)))
    partners = {i - round(p) for i, p in next(iter(seen))}
    assert len(seen) == 1 and len(partners) > 15


def test_keys_without_site():
    assert SeriesSpec((), "ts").keys == ("ts",)


def test_shapley_scores_are_not_shuffled(spark):
    rows = spark.range(300).select("id", *[((F.col("id") * k) % 7).cast("double").alias(f"x{k}") for k in (1, 3, 5)])
    rows = ml.assemble(rows.withColumn("y", F.col("x1")), ["x1", "x3", "x5"], "y").select("id", "features")
    phi = ml.shapley_values(linear_scorer([2.0, 1.0, -1.0]), rows, rows, ["x1", "x3", "x5"], ["id"], permutations=3)
    # a draw's scores meet where its row is, without a list of them
    assert "collect_list" not in phi._jdf.queryExecution().optimizedPlan().toString()
    found = phi.groupBy("id").agg(F.count("*").alias("n")).collect()
    assert len(found) == 300 and {r.n for r in found} == {3}


def test_auto_fill_leaves_no_row_without_lags(spark):
    df = weather_table(spark, hole=60).withColumn("TAIR", F.when(F.col("id") != 0, F.col("TAIR")))
    assert impute_ml.choose_methods(df, SPEC, ["TAIR"]) == {"TAIR": "gradient_boosting"}
    out = impute_ml.fill_gaps(df, SPEC, "auto", ["TAIR"], SMALL, sensors=SENSORS)
    assert out.where("TAIR IS NULL").count() == 0 and out.count() == df.count()
