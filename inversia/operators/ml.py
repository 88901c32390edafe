"""Spark ML models: forests, boosted variants, a stacked ensemble, and what explains them.

Explanations score any model: ``scorer`` takes a table with a ``features`` vector and adds
``prediction``. They expand each row into the altered rows the method asks for and score all of
them in one pass; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.operators.cell_trees import fit_on_cells
from inversia.operators.modeling import score_columns, scores, with_folds
from inversia.operators.quantiles import exact_quantiles
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec
from inversia.session import staged

Scorer = Callable[[DataFrame], DataFrame]
SEED = 42
# Tasks of a shuffled column hold about so many rows; the order goes on from task to task.
ROWS_PER_TASK = 100_000
PLANNED_AT_ONCE = 4
FOLDS = 5


def assemble(matrix: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``features`` vector and ``label`` beside the other columns."""
    out = VectorAssembler(inputCols=list(features), outputCol="features").transform(matrix)
    return out.withColumn("label", F.col(target).cast("double"))


def fit_forest(train: DataFrame, trees: int = 100, depth: int = 10, leaf: int = 2, seed: int = SEED) -> Model:
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", maxBins=128, seed=seed
    )
    return forest.fit(train)


def importance_table(model: Model, features: Sequence[str], train: DataFrame) -> DataFrame:
    """Impurity importance per feature (one row per model column)."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# -- permutation importance ------------------------------------------------------------------


def permutation_importance(
    scorer: Scorer,
    test: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    repeats: int = 10,
    seed: int = SEED,
    draw: Callable[[int], Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Mean and deviation over ``repeats`` of the loss in R2 when one feature is shuffled.

    A repeat puts all rows in random order and passes the feature vector on to the next row, from
    the last row to the first: a permutation of the column. The order is cut like a long series,
    so no task holds it whole and the draw doesn't depend on the cuts. ``draw(repeat)`` may
    replace the random order."""
    order = draw or (lambda r: F.xxhash64(*keys, F.lit(seed * 1000 + r)))
    # the scored rows, written once for all repeats
    rows = staged(test.select(*keys, "label", vector_to_array("features").alias("_x")), "permuted")
    base = scorer(rows.select("label", array_to_vector("_x").alias("features"))).agg(score_columns()[2]).first()["r2"]

    def shuffled(r: int) -> DataFrame:
        drawn = rows.withColumn("_o", order(r))
        spec = SeriesSpec((), "_o", tuple(keys), rows_per_chunk=rows_per_task)
        layout = plan_layout(drawn, spec)
        first = drawn.orderBy(*spec.order).select("_x").first()
        wrapped = F.array(*[F.lit(v) for v in (first["_x"] if first else [])]).cast("array<double>")
        placed = layout.spread(drawn, lookahead=1).withColumn("_y", F.coalesce(F.lead("_x").over(layout.window), wrapped))
        return layout.own(placed).select("label", "_x", "_y", F.lit(r).alias("repeat"))

    # the cuts of the repeats are planned at the same time
    with ThreadPoolExecutor(max_workers=PLANNED_AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(test.sparkSession)(shuffled), range(repeats)))
    stacked = reduce(DataFrame.unionByName, parts)
    changed = F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.col("_y")[F.col("_j")]).otherwise(v))
    altered = stacked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1)))).select(
        "label", "repeat", "_j", array_to_vector(changed).alias("features")
    )
    by_repeat = scorer(altered).groupBy("_j", "repeat").agg(score_columns()[2])
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_j") + 1)
    loss = F.lit(base).cast("double") - F.col("r2")
    return by_repeat.groupBy(name.alias("feature")).agg(
        F.avg(loss).alias("perm_importance_mean"), F.stddev_pop(loss).alias("perm_importance_std")
    )


# -- Shapley values --------------------------------------------------------------------------


def _numbered(df: DataFrame, order: Column, keys: Sequence[str], name: str, kept: Sequence[str], rows_per_task: int) -> DataFrame:
    """The ``kept`` columns of rows with their place in the order, from 0, written once so that places stay."""
    placed = df.withColumn("_o", order)
    layout = plan_layout(placed, SeriesSpec((), "_o", tuple(keys), rows_per_chunk=rows_per_task))
    return staged(layout.own(layout.spread(placed).withColumn(name, layout.position())).select(*kept, name), "numbered")


def shapley_values(
    scorer: Scorer,
    rows: DataFrame,
    background: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    permutations: int = 20,
    seed: int = SEED,
    order: Column | None = None,
    partner: Callable[[Column], Column] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sampled Shapley values, long: keys, feature, phi, for every one of ``rows``.

    For each row and draw, features are taken over from a background row to the row itself in
    random order; a feature's contribution is the change of the prediction when its turn comes.
    Along a draw the contributions add up to f(row) - f(background row). A draw of d features
    needs d + 1 scores.

    Any row of ``background`` may be drawn: its rows are numbered in random order and a draw picks
    one by a hash modulo their number. ``order`` and ``partner(draw)`` may replace both. Rows with
    equal keys are explained apart. Explain fewer rows by giving fewer (``sample_rows``).

    Draws go to the background as numbers and come back to their row with one vector each. From
    there on a row's scores are made and added up where the row is: none of them is shuffled.
    Both tables are read several times."""
    d = len(features)
    explained = _numbered(
        rows.select(*keys, vector_to_array("features").alias("_x")), F.xxhash64(*[F.col(k) for k in keys]), keys, "_row", [*keys, "_x"], rows_per_task
    )
    by = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)) if order is None else order
    pool = _numbered(background.select(*keys, vector_to_array("features").alias("_z")), by, keys, "_b", ["_z"], rows_per_task)
    count = pool.count()
    pick = F.xxhash64("_row", "_draw", F.lit(seed)) if partner is None else partner(F.col("_draw"))
    draws = explained.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    # no background, no draws: the join below is empty
    picked = draws.select("_row", "_draw", F.pmod(pick, F.lit(max(count, 1))).cast("bigint").alias("_b")).join(pool, "_b").drop("_b")
    paired = explained.join(picked, "_row")
    # random feature order of the draw: sort feature numbers by hash
    numbers = F.sequence(F.lit(0), F.lit(d - 1))
    hashed = F.transform(numbers, lambda j: F.struct(F.xxhash64("_row", "_draw", j, F.lit(seed)).alias("h"), j.alias("j")))
    turns = F.transform(F.array_sort(hashed), lambda s: s["j"])
    # after step s the first s features of the order are the row's own
    steps = paired.withColumn("_order", turns).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = F.transform(
        "_x", lambda v, i: F.when(F.array_position("_order", i.cast("int")) <= F.col("_s"), v).otherwise(F.col("_z")[i])
    )
    scored = scorer(steps.select(*keys, "_row", "_draw", "_s", array_to_vector(mixed).alias("features")))
    after = [F.max(F.when(F.col("_s") == s, F.col("prediction"))) for s in range(d + 1)]
    path = scored.groupBy(*keys, "_row", "_draw").agg(F.array(*after).alias("_p")).withColumn("_order", turns)
    turn = lambda j: F.array_position("_order", j.cast("int")).cast("int")
    change = F.transform(numbers, lambda j: F.get("_p", turn(j)) - F.get("_p", turn(j) - 1))
    means = path.select(*keys, "_row", change.alias("_phi")).groupBy(*keys, "_row").agg(F.array(*[F.avg(F.col("_phi")[j]) for j in range(d)]).alias("_phi"))
    named = F.transform("_phi", lambda phi, j: F.struct(F.element_at(F.array(*[F.lit(f) for f in features]), j + 1).alias("feature"), phi.alias("phi")))
    return means.select(*keys, F.inline(named))


def shapley_importance(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("shap_importance"))


def explain_row(phi: DataFrame, row: Column) -> DataFrame:
    """Contributions to one prediction, largest first. To have no others made, explain only its rows."""
    return phi.where(row).orderBy(F.desc(F.abs("phi")), "feature")


def shapley_spread(phi: DataFrame) -> DataFrame:
    """Quartiles and range of each feature's values; ``phi`` is read several times."""
    quartiles = exact_quantiles(phi, ["phi"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["feature"]).drop("variable")
    ends = phi.groupBy("feature").agg(F.min("phi").alias("low"), F.max("phi").alias("high"))
    return ends.join(quartiles, "feature").select("feature", "low", "q1", "median", "q3", "high")


# -- boosted variants and stacking -------------------------------------------------------------


def boosted_variants(rounds: int = 200, depth: int = 6, rate: float = 0.1, seed: int = SEED) -> dict[str, GBTRegressor]:
    """Row and column subsampling, column subsampling only, and none."""
    base = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "maxBins": 64, "seed": seed}
    return {
        "gbt_row_col": GBTRegressor(subsamplingRate=0.8, featureSubsetStrategy="0.8", **base),
        "gbt_col": GBTRegressor(featureSubsetStrategy="0.8", **base),
        "gbt_full": GBTRegressor(**base),
    }


def predict(model: Model, rows: DataFrame, name: str = "prediction") -> DataFrame:
    return model.transform(rows).withColumnRenamed("prediction", name)


class Stacked:
    """Base models whose out-of-fold predictions train a linear model on top."""

    def __init__(self, bases: dict[str, Model], top: Model):
        self.bases, self.top = bases, top

    def transform(self, rows: DataFrame) -> DataFrame:
        out = rows
        for name, model in self.bases.items():
            out = predict(model, out, f"_p_{name}")
        return self.combine(out).drop(*[f"_p_{n}" for n in self.bases])

    def combine(self, predicted: DataFrame, name: str = "prediction") -> DataFrame:
        """What the linear model makes of the bases' predictions, which the rows have already."""
        out = predicted.withColumnRenamed("features", "_features")
        stacked = VectorAssembler(inputCols=[f"_p_{n}" for n in self.bases], outputCol="features").transform(out)
        return predict(self.top, stacked, name).drop("features").withColumnRenamed("_features", "features")


def fit_stacked(
    train: DataFrame, spec: SeriesSpec, estimators: dict[str, GBTRegressor], fitted: dict[str, Model], folds: int = FOLDS
) -> Stacked:
    """Every base is fitted on all folds but one and predicts that one; the linear model learns
    from these predictions. The fold table is stored once for the many fits."""
    table = with_folds(train, spec, folds)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = []
        for k in range(folds):
            seen, out = table.where(F.col("fold") != k), table.where(F.col("fold") == k)
            for name, estimator in estimators.items():
                out = predict(estimator.fit(seen), out, f"_p_{name}")
            held.append(out)
        stacked = reduce(DataFrame.unionByName, held).drop("features")
        top_rows = VectorAssembler(inputCols=[f"_p_{n}" for n in estimators], outputCol="features").transform(stacked)
        return Stacked(fitted, LinearRegression().fit(top_rows.select("features", "label")))
    finally:
        table.unpersist()


def train_all(
    train: DataFrame, test: DataFrame, spec: SeriesSpec, rounds: int = 200, depth: int = 6, folds: int = FOLDS, stack: bool = True
) -> tuple[dict[str, Model], DataFrame]:
    """The three boosted variants and their stack; predictions of the test rows, stacked by model.

    Trees are grown over cells of rows (``cell_trees``), all variants and folds at the same time; a
    table of too many cells has Spark's own fits, one after another. A column ``fold`` of ``train`` is
    taken as it is, contiguous folds are made where there is none."""
    estimators = boosted_variants(rounds, depth)
    grown = fit_on_cells(train, spec, estimators, folds if stack else 0)
    asked = test.select(*spec.keys, "features", "label")
    if grown is not None:
        models: dict[str, Model] = dict(grown.models)
        if stack:
            rows = VectorAssembler(inputCols=[f"_p_{n}" for n in estimators], outputCol="features").transform(grown.held)
            models["stacked"] = Stacked(grown.models, LinearRegression(weightCol="weight").fit(rows.select("features", "label", "weight")))
        scored = grown.predict(asked)
    else:
        models = {n: e.fit(train) for n, e in estimators.items()}
        if stack:
            models["stacked"] = fit_stacked(train, spec, estimators, dict(models), folds)
        scored = reduce(lambda rows, name: predict(models[name], rows, f"_p_{name}"), estimators, asked)  # a row is given to each base once
    if stack:
        scored = models["stacked"].combine(scored, "_p_stacked")
    shown = F.inline(F.array(*[F.struct(F.col(f"_p_{n}").alias("prediction"), F.lit(n).alias("model")) for n in models]))
    return models, scored.select(*spec.keys, "label", shown)


def evaluate(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return scores(predictions, by)
