"""How often jobs go over their input, and how much of it they write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inversia.operators import windows
from inversia.plans import jobs
from inversia.queries import REGISTRY, features, models
from inversia.queries.views import rounded
from tests.helpers import SPEC, hot_table
from tests.test_layout import count_scans

FOLDER = "/root/testdata/sf0.001"


class Written(Exception):
    pass


def test_a_forecast_writes_only_what_its_models_read(spark, monkeypatch):
    def watched(df, name):
        raise Written(df.columns)

    monkeypatch.setattr(jobs, "staged", watched)
    with pytest.raises(Written) as written:
        REGISTRY["forecast"].run(spark, FOLDER)
    assert len(written.value.args[0]) <= 16


def test_a_training_matrix_goes_over_its_input_twice(spark):
    df = hot_table(spark).cache()
    rows = df.count()

    def matrix(counted):
        jobs.training_matrix(counted(df), SPEC, ["u"], "v", False, site_effect=True)[0].collect()

    assert count_scans(spark, matrix) == 2 * rows  # planned and written


def test_features_are_made_once_for_all_sinks(spark, tmp_path):
    df = hot_table(spark).withColumn("VT_inversion_90_05", F.col("v")).cache()
    rows = df.count()
    assert count_scans(spark, lambda counted: jobs.save_features(counted(df), str(tmp_path / "out"), SPEC)) == rows


def test_a_site_is_filled_and_split_once(spark, monkeypatch):
    seen, real = [], jobs.staged

    def watched(df, name):
        if name == "explained":
            raise Written(df.inputFiles())
        seen.append(name)
        return real(df, name)

    monkeypatch.setattr(jobs, "staged", watched)
    with pytest.raises(Written) as written:
        jobs.explain_site(hot_table(spark), SPEC, "v", ["u"])
    assert seen == ["filled", "split"] and all("/split-" in f for f in written.value.args[0])


def test_learnable_rows_are_split_once(spark):
    train, test = models._learnable(spark, FOLDER)
    assert all("/learnable-" in f for f in train.inputFiles() + test.inputFiles())


def test_rolling_statistics_aggregate_no_frame_for_each_row(spark):
    plan = windows.add_rolling(hot_table(spark), SPEC, ["v", "u"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame" in plan and "currentrow" not in plan


def test_features_are_shuffled_as_sensors(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    try:
        plan = REGISTRY["feature_build"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    behind, before = plan.split("Exchange hashpartitioning", 1)
    assert "EXP(" in behind.upper() and "EXP(" not in before.upper()


def test_wide_rounding_is_sparks(spark):
    rng = np.random.default_rng(5)
    found = [*(rng.normal(size=400) * 10.0 ** rng.integers(-6, 16, 400)).tolist(), 0.0, -0.0, 0.5, -0.00005, 1e300, -3e-9, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(found)], "i long, v double")
    a, b = [dict(map(tuple, t.collect())) for t in (features._rounded_wide(df, 4), rounded(df, 4))]
    assert str(a) == str(b)
