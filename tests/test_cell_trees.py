"""Trees grown over cells of rows, against trees grown from rows one by one and Spark's own."""

import inspect
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inversia.operators import cell_trees, ml, modeling
from inversia.operators.cell_trees import Cells, Variant
from inversia.queries import models
from tests.helpers import SPEC

N, D = 600, 3


def table(spark, rows=N, seed=5, levels=6):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        x = [float(rng.randrange(levels)) for _ in range(D)]
        data.append((rng.choice(["hot", "hot", "x"]), i // 3, i, x, 3.0 * x[0] + (x[1] > 2) * 7 - x[0] * x[2] + rng.random()))
    rows = spark.createDataFrame(data, "site string, ts long, id long, x array<double>, label double").repartition(3)
    return rows.select("site", "ts", "id", array_to_vector("x").alias("features"), "label", "x")


def plain_tree(x, y, w, depth):
    """Nested (feature, value, left, right) or a mean, from rows one by one."""
    mean = (y * w).sum() / w.sum()
    best = None
    for f in range(x.shape[1]) if depth else ():
        for cut in sorted(set(x[w > 0, f]))[:-1]:
            left = x[:, f] <= cut
            nl, nr, tl, tr = w[left].sum(), w[~left].sum(), (y * w)[left].sum(), (y * w)[~left].sum()
            gain = tl * tl / nl + tr * tr / nr - (tl + tr) ** 2 / (nl + nr)
            if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-6)):
                best = (gain, f, cut, left)
    if best is None:
        return mean
    _, f, cut, left = best
    return (f, cut, plain_tree(x[left], y[left], w[left], depth - 1), plain_tree(x[~left], y[~left], w[~left], depth - 1))


def follow(tree, row):
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def plain_boosting(x, y, weights, depth, rate):
    p = np.zeros(len(y))
    for k, w in enumerate(weights):
        tree = plain_tree(x, y if k == 0 else 2 * (y - p), w, depth)
        p += (1.0 if k == 0 else rate) * np.array([follow(tree, row) for row in x])
    return p


def test_cells_grow_the_trees_of_their_rows(spark):
    df = table(spark)
    found = cell_trees.fit_on_cells(df, SPEC, {"gbt_full": ml.boosted_variants(4, 3)["gbt_full"]}, 0)
    got = {r.id: r for r in found.predict(df.select("id", "features", "x", "label")).collect()}
    rows = [got[i] for i in range(N)]
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    want = plain_boosting(x, y, [np.ones(N)] * 4, 3, 0.1)
    assert np.allclose([r["_p_gbt_full"] for r in rows], want)
    # the model as Spark's own says the same, and can be asked for its importance
    again = {r.id: r.prediction for r in found.models["gbt_full"].transform(df).collect()}
    assert np.allclose([again[i] for i in range(N)], want)
    assert found.models["gbt_full"].getNumTrees == 4 and found.models["gbt_full"].featureImportances.toArray().sum() == pytest.approx(1)


def test_every_row_is_drawn_for_itself_and_draws_repeat(spark, monkeypatch):
    # few trees and cells at once: several rounds of drawing and growing
    monkeypatch.setattr(cell_trees, "MOST_TREES", 2)
    monkeypatch.setattr(cell_trees, "CELLS_A_ROW", 50)
    monkeypatch.setattr(cell_trees, "PACKED_A_ROW", 40)
    monkeypatch.setattr(cell_trees, "ROWS_AT_ONCE", 100)
    df = table(spark)
    variant = {"gbt_row_col": ml.GBTRegressor(maxIter=5, maxDepth=2, subsamplingRate=0.8, maxBins=64, seed=42)}
    first, second = (
        {r.id: r for r in cell_trees.fit_on_cells(d, SPEC, variant, 0).predict(df.select("id", "features", "x", "label")).collect()} for d in (df, df.repartition(7))
    )
    assert all(first[i]["_p_gbt_row_col"] == pytest.approx(second[i]["_p_gbt_row_col"]) for i in range(N))
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(*SPEC.keys).alias("h")).collect()}
    h = np.array([hashes[i] for i in range(N)])
    weights = []
    for tree in range(5):
        bits = cell_trees._hashed(h, tree // cell_trees.LANES, 42).view(np.uint16).reshape(-1, cell_trees.LANES)
        weights.append((bits[:, tree % cell_trees.LANES] < round(0.8 * 65536)).astype(float))
    assert all(0.7 < w.mean() < 0.9 for w in weights) and len({w.tobytes() for w in weights}) == 5
    x, y = np.array([first[i].x for i in range(N)]), np.array([first[i].label for i in range(N)])
    assert np.allclose([first[i]["_p_gbt_row_col"] for i in range(N)], plain_boosting(x, y, weights, 2, 0.1))


def test_the_stack_learns_from_models_that_did_not_see_the_fold(spark):
    df = table(spark)
    estimators = {"gbt_full": ml.boosted_variants(3, 2)["gbt_full"]}
    held = cell_trees.fit_on_cells(df, SPEC, estimators, 3).held
    folds = modeling.contiguous_folds(df, SPEC, 3).collect()
    want = {}
    for k in range(3):
        seen, out = [r for r in folds if r.fold != k], [r for r in folds if r.fold == k]
        x = np.array([r.x for r in [*seen, *out]])
        y = np.array([r.label for r in [*seen, *out]])
        w = np.r_[np.ones(len(seen)), np.zeros(len(out))]
        for r, p in zip(out, plain_boosting(x, y, [w] * 3, 2, 0.1)[len(seen) :]):
            cell = want.setdefault((k, tuple(r.x)), [[], p])
            cell[0].append(r.label)
    got = sorted((r.weight, round(r.label, 6), round(r["_p_gbt_full"], 6)) for r in held.collect())
    assert got == sorted((float(len(ys)), round(float(np.mean(ys)), 6), round(float(p), 6)) for ys, p in want.values())
    assert sum(r[0] for r in got) == N


def test_folds_of_the_split_are_taken_as_they_are(spark, monkeypatch):
    df = table(spark)
    split = modeling.chronological_split(df, SPEC, folds=3)
    made = []
    real = modeling.contiguous_folds
    monkeypatch.setattr(modeling, "contiguous_folds", lambda *a: (made.append(1), real(*a))[1])
    estimators = {"gbt_full": ml.boosted_variants(3, 2)["gbt_full"]}
    known, apart = (
        sorted((round(r.label, 9), r.weight, round(r["_p_gbt_full"], 9)) for r in cell_trees.fit_on_cells(t, SPEC, estimators, 3).held.collect())
        for t in (split.where("is_train"), split.where("is_train").drop("fold"))
    )
    assert known == apart and made == [1]


def test_rows_of_unseen_cells_are_predicted(spark):
    df = table(spark)
    models_, predictions = ml.train_all(df.where("id % 5 != 0"), df.where("id % 5 = 0").unionByName(table(spark, 40, 9, 12)), SPEC, rounds=3, depth=3, folds=2)
    got = {(r.site, r.id, r.model, round(r.label, 9)): r.prediction for r in predictions.collect()}
    assert len(got) == 4 * 160
    asked = df.where("id % 5 = 0").unionByName(table(spark, 40, 9, 12))
    for name, model in models_.items():
        for r in model.transform(asked).collect():
            assert got[r.site, r.id, name, round(r.label, 9)] == pytest.approx(r.prediction)


def test_a_table_of_too_many_cells_has_sparks_fits(spark, monkeypatch):
    monkeypatch.setattr(cell_trees, "MOST_BYTES", 100)
    df = table(spark)
    assert cell_trees.fit_on_cells(df, SPEC, ml.boosted_variants(2, 2), 2) is None
    fitted, predictions = ml.train_all(df, df, SPEC, rounds=2, depth=2, folds=2)
    assert predictions.groupBy("model").count().where(F.col("count") == N).count() == 4 and set(fitted) == {"gbt_row_col", "gbt_col", "gbt_full", "stacked"}


def test_a_feature_of_one_value(spark):
    df = table(spark, 60).withColumn("features", array_to_vector(F.array(F.col("x")[0], F.lit(3.0))))
    found = cell_trees.fit_on_cells(df, SPEC, {"gbt_full": ml.boosted_variants(2, 2)["gbt_full"]}, 0)
    assert list(found.models["gbt_full"].featureImportances.toArray()) == [1.0, 0.0]


def test_nothing_to_learn_from(spark):
    df = table(spark)
    with pytest.raises(ValueError):
        cell_trees.fit_on_cells(df.where("false"), SPEC, ml.boosted_variants(2, 2), 2)


def test_the_tree_of_a_node_draws_columns():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 4, (6, 200)).astype(np.uint8)
    cells = Cells(bins, (4,) * 6, np.ones((1, 200)), bins.astype(float).sum(0)[None])
    trees, _ = cell_trees.boost(cells, Variant(20, 1, 0.1, 1.0, 2, 7), -1, 0, 20, None, None)
    assert len({int(t["feature"][0]) for t in trees}) > 2


def test_the_query_fits_whole_models(spark, monkeypatch):
    """200 rounds of depth 6, five folds."""
    asked = {}

    def train_all(train, test, spec, *sizes, **named):
        bound = inspect.signature(real).bind(train, test, spec, *sizes, **named)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return {}, test.select(*spec.keys, "label", F.col("label").alias("prediction"), F.lit("m").alias("model"))

    real = ml.train_all
    monkeypatch.setattr(ml, "train_all", train_all)
    models.QUERIES["boosted_and_stacked"].run(spark, "/root/testdata/sf0.001")
    assert (asked["rounds"], asked["depth"], asked["folds"], asked["stack"]) == (200, 6, 5, True)
