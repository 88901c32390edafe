"""Quantiles by brackets: the same numbers, few rows moved; model checks that a useless model fails."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from inversia.operators import ml, quantiles
from inversia.queries import REGISTRY


def values(spark, n=30_000):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.gauss(0, 1), float(i % 7), None if i % 3 else rng.random()) for i in range(n)] + [("few", 1.5, 2.0, None)]
    return spark.createDataFrame(rows, "g string, x double, tied double, holes double").repartition(6)


def test_brackets_give_the_same_numbers(spark):
    df, wanted = values(spark), {"low": 0.001, "q1": 0.25, "median": 0.5, "top": 1.0, "bottom": 0.0}
    whole = quantiles.exact_quantiles(df, ["x", "tied", "holes"], wanted, ["g"], bracket_from=10**9)
    near = quantiles.exact_quantiles(df, ["x", "tied", "holes"], wanted, ["g"], bracket_from=1)
    a, b = ({(r.g, r.variable): tuple(round(r[n], 12) for n in wanted) for r in t.collect()} for t in (whole, near))
    assert a == b and len(a) == 11  # the small group knows nothing of one column
    xs = sorted(r.x for r in df.where("g = 'a'").collect())
    assert a["a", "x"][2] == pytest.approx(statistics.median(xs))


def test_brackets_that_fail_are_done_whole(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "REACH", -400.0)  # brackets that miss their rank
    df = values(spark, 2_000)
    near = quantiles.exact_quantiles(df, ["x"], {"median": 0.5}, bracket_from=1).first()
    assert near["median"] == pytest.approx(statistics.median(r.x for r in df.collect()))


def test_few_values_are_shuffled(spark, monkeypatch):
    """Of a hundred thousand different values under 5 % are counted and sorted."""
    df = spark.range(100_000).select((F.xxhash64("id") / 1e12).alias("x"))
    seen = {}
    real = quantiles.staged

    def watched(table, name):
        out = real(table, name)
        if name == "counts":
            seen["rows"] = out.count()
        return out

    monkeypatch.setattr(quantiles, "staged", watched)
    got = quantiles.exact_quantiles(df, ["x"], {"median": 0.5, "top": 0.999}, bracket_from=1).first()
    xs = sorted(r.x for r in df.collect())
    assert got["median"] == pytest.approx(statistics.median(xs), rel=1e-12) and seen["rows"] < 5_000


def test_a_constant_model_fails_the_checks(spark, monkeypatch):
    real = ml.fit_forest
    monkeypatch.setattr(ml, "fit_forest", lambda train, *a, **k: real(train.withColumn("label", F.lit(1.0)), trees=1, depth=1))
    rows = REGISTRY["forest_importance"].run(spark, "/root/testdata/sf0.001").collect()
    assert not any(r.beats_mean for r in rows)
