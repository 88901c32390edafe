"""The parts of modelling that are plain tables: splits, matrices, scores, ranks, reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.functions.coercion import existing, numeric_columns
from inversia.operators.filters import inversion_rows
from inversia.operators.impute import mean_fill
from inversia.operators.windows import clean_extremes
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec


def _placed(df: DataFrame, spec: SeriesSpec, **columns: Callable[[Column, Column], Column]) -> DataFrame:
    """Add columns made of the row's position and its series' length."""
    layout = plan_layout(df, spec)
    rows = layout.spread(df).withColumns({"_at": layout.position(), "_of": layout.length()})
    made = {n: f(F.col("_at"), F.col("_of")) for n, f in columns.items()}
    return layout.own(rows.withColumns(made)).drop("_at", "_of")


def chronological_split(df: DataFrame, spec: SeriesSpec, test_size: float = 0.2, name: str = "is_train", folds: int = 0) -> DataFrame:
    """True for the first ``floor(n * (1 - test_size))`` rows of each series. With ``folds`` those rows also
    have the ``fold`` that ``contiguous_folds`` gives them, in the same pass; others have none."""
    first = lambda of: F.floor(of * F.lit(1 - test_size))
    columns = {name: lambda at, of: at < first(of)}
    if folds:
        columns["fold"] = lambda at, of: F.when(at < first(of), _fold(at, first(of), folds))
    return _placed(df, spec, **columns)


def _fold(at: Column, of: Column, folds: int) -> Column:
    small = F.floor(of / folds)
    extra = of % folds
    edge = extra * (small + 1)
    late = extra + F.floor(F.try_divide(at - edge, small))
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(late).cast("int")


def contiguous_folds(df: DataFrame, spec: SeriesSpec, folds: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous folds in time order, the first ``n % folds`` of them one row longer."""
    return _placed(df, spec, **{name: lambda at, of: _fold(at, of, folds)})


def with_folds(train: DataFrame, spec: SeriesSpec, folds: int) -> DataFrame:
    """Keys, features, label and ``fold`` of training rows; a split may have given them their fold before."""
    rows = [*spec.keys, "features", "label"]
    return train.select(*rows, "fold") if "fold" in train.columns else contiguous_folds(train.select(*rows), spec, folds)


def thin(df: DataFrame, spec: SeriesSpec, points: int) -> DataFrame:
    """Evenly spaced rows of each series, ``points`` of them, ends included; shorter series whole."""

    def chosen(at: Column, of: Column) -> Column:
        if points == 1:
            return at == 0
        last = F.lit(points - 1)
        i = F.ceil(F.try_divide(at * last, of - 1))
        exact = F.floor(F.try_divide(i * (of - 1), last)) == at
        return (of <= points) | F.coalesce((i <= last) & exact, F.lit(False))

    return _placed(df, spec, _chosen=chosen).where("_chosen").drop("_chosen")


def model_matrix(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str] = (),
    focus_inversion: bool = False,
    fit_rows: Column | None = None,
) -> DataFrame:
    """Rows with a known target, features finite, capped and mean-filled; ``fit_rows`` restricts
    the rows that means come from (default: all, as a plain column mean)."""
    rows = df.where(F.col(target).isNotNull())
    if focus_inversion:
        rows = inversion_rows(rows)
    numeric = [c for c in numeric_columns(rows) if c in set(features)]
    kept = [c for c in dict.fromkeys([*keys, target]) if c not in numeric]
    flags = [] if fit_rows is None else [fit_rows.alias("_fit")]
    matrix = rows.select(*kept, *[F.col(c).cast("double").alias(c) for c in numeric], *flags)
    matrix = clean_extremes(matrix, numeric)
    source = matrix if fit_rows is None else matrix.where("_fit")
    return mean_fill(matrix, numeric, source).drop("_fit")


def known_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with a known value in some row (one aggregate)."""
    cols = existing(df, columns)
    if not cols:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c]]


def score_columns(y: str = "label", p: str = "prediction") -> list[Column]:
    """RMSE, MAE and R2 as aggregates; R2 of a constant target is null."""
    error = F.col(y) - F.col(p)
    spread = F.count(y) * F.var_pop(y)
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.sum(error * error), spread)).alias("r2"),
    ]


def scores(predictions: DataFrame, by: Sequence[str] = (), y: str = "label", p: str = "prediction") -> DataFrame:
    """Scores per group of a stacked prediction table (site, target, model, label, prediction)."""
    known = predictions.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return known.groupBy(*by).agg(*score_columns(y, p))


def best_models(results: DataFrame, by: Sequence[str] = ("site", "target")) -> DataFrame:
    """The model with the smallest RMSE per site and target; of equals the first by name."""
    best = F.min_by(F.struct("model", "rmse", "r2"), F.struct("rmse", "model")).alias("_best")
    return results.groupBy(*by).agg(best).select(*by, "_best.model", "_best.rmse", "_best.r2")


def ranked(table: DataFrame, by: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank 1..n by descending value. Importance tables hold one row per feature, so the window
    over a whole group is as short as the list of model columns."""
    w = Window.partitionBy(*groups).orderBy(F.desc(by), "feature")
    return table.withColumn(name, F.row_number().over(w))


def importance_ranks(table: DataFrame) -> DataFrame:
    """Ranks by impurity and by permutation importance."""
    both = ranked(table, "importance", "rf_rank")
    return ranked(both, "perm_importance_mean", "perm_rank")


def compare_methods(forest: DataFrame, shapley: DataFrame) -> DataFrame:
    """Both rankings joined on the feature, with their mean rank, best first."""
    a = ranked(forest, "importance", "rf_rank")
    b = ranked(shapley, "shap_importance", "shap_rank")
    joined = a.join(b, "feature").withColumn("avg_rank", (F.col("rf_rank") + F.col("shap_rank")) / 2)
    return joined.select(
        "feature", "importance", "perm_importance_mean", "rf_rank", "shap_importance", "shap_rank", "avg_rank"
    ).orderBy("avg_rank", "rf_rank")


def average_rank(value: str, groups: Sequence[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    w = Window.partitionBy(*groups)
    low = F.rank().over(w.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, value))
    return low + (ties - 1) / 2


def rank_correlation(table: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of two columns of a feature table."""
    ranks = table.select(*groups, average_rank(a, groups).alias("_a"), average_rank(b, groups).alias("_b"))
    return ranks.groupBy(*groups).agg(F.corr("_a", "_b").alias("spearman"))


def top_k(table: DataFrame, by: str, k: int, groups: Sequence[str] = (), tie: str = "feature") -> DataFrame:
    """The k largest rows, per group if there are groups (a group-limited window)."""
    if not groups:
        return table.orderBy(F.desc(by), tie).limit(k)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(by), tie))
    return table.withColumn("rank", rank).where(F.col("rank") <= k)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all) without replacement: the n smallest MD5s of the row key as text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.withColumn("_h", F.md5(text)).orderBy("_h", *keys).limit(n).drop("_h")


def significance_report(tables: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Top features of every method and site in one table: method, site, feature, score, rank.
    Each table has columns site, feature, score."""
    parts = [
        top_k(t, "score", k, ["site"]).select(F.lit(m).alias("method"), "site", "feature", "score", "rank")
        for m, t in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
