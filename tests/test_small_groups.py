"""Models of small groups, fitted where their rows are, against those grown by Spark's aggregates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inversia.operators import grouped_trees, modeling, small_groups
from inversia.operators.grouped_trees import Growth
from inversia.plans import site_models
from tests.helpers import SPEC, hot_table

FEATURES, TARGETS = ["a", "b", "c"], {"now": "y", "other": "z"}


def table(spark, rows=500, seed=11):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        site = rng.choice(["hot", "hot", "hot", "x", None, "tiny"] if i % 9 else ["hot", "x"])
        a, b, c = (rng.choice([None, float("nan"), float("inf")]) if rng.random() < 0.1 else float(rng.randrange(7)) for _ in range(3))
        z = [0.0 if v is None or not math.isfinite(v) else v for v in (a, b, c)]
        y = None if rng.random() < 0.1 else z[0] * 5 + (z[1] > 2) * 9 + rng.random()
        data.append((site, i // 2, i, a, b, None if site == "x" else c, y, z[2] + rng.random()))
    data.append(("alone", 1, 10**6, 1.0, 2.0, 3.0, 4.0, None))
    return spark.createDataFrame(data, "site string, ts long, id long, a double, b double, c double, y double, z double").repartition(5)


def forecast(df, growth, **sizes):
    found = site_models.forecast_all_sites(df, SPEC, TARGETS, FEATURES, False, growth, **sizes)
    predictions = {(r.site, r.target, r.model, r.id): r.prediction for r in found["predictions"].collect()}
    shares = {(r.site, r.target, r.model, r.feature): r.importance for r in found["importance"].collect()}
    return predictions, shares


@pytest.mark.parametrize("growth", [Growth(rounds=3, depth=3, rate=0.5, bits=52), Growth(rounds=2, depth=2, least=4.0, bins=4, bits=3)])
def test_small_groups_have_the_models_of_large_ones(spark, monkeypatch, growth):
    df = table(spark)
    small = forecast(df, growth, folds=3)
    monkeypatch.setattr(grouped_trees, "MOST_CELLS", 300)  # the hot site is large
    mixed = forecast(df, growth, folds=3)
    monkeypatch.setattr(grouped_trees, "MOST_CELLS", 0)
    large = forecast(df, growth, folds=3)
    for got in (small, mixed):
        for mine, theirs in zip(got, large):
            assert mine.keys() == theirs.keys() and len(mine) > 40
            assert all(math.isclose(mine[k], theirs[k], abs_tol=1e-6) for k in mine if "stacked" not in k)
    assert {k[2] for k in small[0]} == {"gbt_row_col", "gbt_col", "gbt_full", "stacked"}


def test_groups_of_a_task_are_fitted_some_at_a_time(spark, monkeypatch):
    growth, df = Growth(rounds=2, depth=2, rate=0.5), table(spark)
    split = modeling.chronological_split(df.where("y IS NOT NULL").withColumn("label", F.col("y")).repartition("site"), SPEC, folds=2).sortWithinPartitions("site")

    def run():
        out = small_groups.fit_folds(split, ["site"], SPEC.order, FEATURES, SPEC.keys, range(-1, 2), site_models.variants(growth))
        return {(r.site, r.id, n): r[n] for r in out.where("shares IS NULL").collect() for n in ("gbt_row_col", "gbt_full")}

    whole = run()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(small_groups, "ROWS_AT_ONCE", 20)
        assert run() == pytest.approx(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_without_a_stack(spark, monkeypatch):
    growth, df = Growth(rounds=2, depth=2, rate=0.5), table(spark)
    small = forecast(df, growth, stack=False)
    monkeypatch.setattr(grouped_trees, "MOST_CELLS", 0)
    large = forecast(df, growth, stack=False)
    assert small[0].keys() == large[0].keys() and {k[2] for k in small[0]} == {"gbt_row_col", "gbt_col", "gbt_full"}
    assert all(math.isclose(small[0][k], large[0][k], abs_tol=1e-6) for k in small[0])


def test_a_row_is_not_written_again_by_fold_or_round(spark, monkeypatch):
    written = []

    def staged(df, name, write=site_models.staged):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(site_models, "staged", staged)
    monkeypatch.setattr(grouped_trees, "staged", staged)
    df = table(spark)
    forecast(df, Growth(rounds=3, depth=2), folds=4)
    rows = df.count() * len(TARGETS)
    # of the predictions there is a row for each model of a test row
    assert all(n <= rows for name, n in written if name != "predictions") and not {"round", "binned"} & {name for name, _ in written}


def test_folds_come_with_the_split(spark):
    for rows, spec in ((600, SPEC), (600, SPEC.but(rows_per_chunk=40)), (7, SPEC)):
        df = hot_table(spark, rows)
        both = modeling.chronological_split(df, spec, folds=4)
        apart = modeling.contiguous_folds(modeling.chronological_split(df, spec).where("is_train"), spec, 4)
        assert sorted(both.where("is_train").select("id", "fold").collect()) == sorted(apart.select("id", "fold").collect())
        assert both.where("NOT is_train AND fold IS NOT NULL").count() == 0


def test_hashes_are_sparks(spark):
    rows = spark.range(50).select("id", F.xxhash64("id", F.lit("a")).alias("h"), F.xxhash64("id", F.lit("a"), F.lit(-1), F.lit(7)).alias("want")).toPandas()
    assert (small_groups.hash_on(small_groups.hash_on(rows.h.to_numpy(), -1), 7) == rows.want.to_numpy()).all()


def test_no_rows(spark):
    assert forecast(table(spark).where("false"), Growth(rounds=2, depth=2), folds=2) == ({}, {})
