"""Exact Shapley values of trees, from a table of leaves.

A leaf is reached through conditions on the features of its path. Knowing a set of features, a row
reaches it with probability one or zero for each known feature (its conditions hold or don't), and
with the share of training rows that take the path's branches for each unknown one. A feature's
Shapley value in that game has a closed form: a sum over how many of the leaf's other features are
known, weighted by ``s! (k - s - 1)! / k!``. A row's values over all leaves of all trees, and the
mean prediction, add up to its prediction exactly; nothing is sampled.

A model sees of a row only between which thresholds its values lie. Rows that lie between the same
ones in every feature are in one cell; cells are explained, and rows take the values of theirs."""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.operators.grouped_trees import GroupedTrees, with_places
from inversia.plans.joins import match
from inversia.session import staged

#: Rows meet the leaves of so many trees at a time.
TREES_AT_ONCE = 25


def leaf_table(model: GroupedTrees) -> DataFrame:
    """Group columns, ``tree``, ``leaf``, ``value`` and ``conditions``: an array of ``f`` (number of
    the feature), ``low``, ``high`` (a value above low and up to high holds, null being below all;
    an absent bound is null) and ``share`` (of the rows above the path's branches on f), one entry
    for each feature on the leaf's path; and ``reached``, the share of rows that come to it."""
    keys = [*model.group, "tree"]
    number = F.element_at(F.create_map(*[x for i, f in enumerate(model.features) for x in (F.lit(f), F.lit(i))]), F.col("feature"))
    nodes = staged(model.trees.select(*keys, "node", number.alias("f"), "threshold", "cover", "value"), "nodes")
    # every ancestor of a node: its number shifted right; a path is as long as the tree is deep
    depth = F.length(F.bin("node")) - 1
    leaves = nodes.where("f IS NULL").withColumn("up", F.explode(F.sequence(F.lit(0), depth)))
    steps = leaves.select(*keys, F.col("node").alias("leaf"), "value", F.expr("shiftright(node, up)").alias("at"), F.expr("shiftright(node, up - 1) % 2").alias("right"), "up", "cover")
    above = nodes.select(*keys, F.col("node").alias("at"), "f", "threshold", F.col("cover").alias("of"))
    taken = nodes.select(*keys, F.col("node").alias("child"), F.col("cover").alias("took"))
    path = match(steps.where("up > 0"), above, [*keys, "at"])
    path = match(path.withColumn("child", F.col("at") * 2 + F.col("right")), taken, [*keys, "child"])
    right = F.col("right") == 1
    by_feature = path.groupBy(*keys, "leaf", "value", "f").agg(
        F.max(F.when(right, F.col("threshold"))).alias("low"),
        F.min(F.when(~right, F.col("threshold"))).alias("high"),
        F.product(F.try_divide("took", "of")).alias("share"),
    )
    whole = by_feature.groupBy(*keys, "leaf", "value").agg(F.array_sort(F.collect_list(F.struct("f", "low", "high", "share"))).alias("conditions"))
    found = match(leaves.where("up = 0").select(*keys, F.col("node").alias("leaf"), "value"), whole.drop("value"), [*keys, "leaf"], "left")
    none = F.array().cast("array<struct<f:int,low:double,high:double,share:double>>")
    conditions = F.coalesce("conditions", none)
    reached = F.aggregate(conditions, F.lit(1.0), lambda a, c: a * c["share"])
    return found.select(*keys, "leaf", "value", conditions.alias("conditions"), reached.alias("reached"))


def _holds(c: Column, x: Column) -> Column:
    above = c["low"].isNull() | F.coalesce(x > c["low"], F.lit(False))
    upto = c["high"].isNull() | F.coalesce(x <= c["high"], F.lit(True))  # null is below all
    return (above & upto).cast("double")


def _weighted(deepest: int) -> Column:
    """Of a leaf with k features and the counts of the polynomial ``_e`` (how much of the leaf is
    reached with s of the other features known): the sum of both sides' weights by s."""
    weights = [[factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)] for k in range(1, deepest + 1)]
    return F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])


def tree_shapley(model: GroupedTrees, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``feature``, ``phi`` of every row and feature, and ``expected``: the mean prediction
    of the row's group. ``expected`` plus a row's values is its prediction (for logistic loss: before
    the logistic function). Rows of groups without a model have no values. Rows with equal keys are
    explained apart, under the same keys. A null is below all values, as in the trees."""
    group, number = list(model.group), {f: i for i, f in enumerate(model.features)}
    leaves = staged(leaf_table(model), "leaves")
    deepest = leaves.agg(F.max(F.size("conditions"))).first()[0] or 0
    means = leaves.groupBy(*group).agg(F.sum(F.col("value") * F.col("reached")).alias("_mean"))
    expected = match(model.base, means, group, "left").select(*group, (F.col("base") + F.coalesce("_mean", F.lit(0.0))).alias("expected"))
    edges = staged(_thresholds(model), "thresholds")
    cells = with_places(rows.select(*dict.fromkeys([*group, *keys, *number])), edges, group, list(number), "_cells", 0)
    cells = staged(match(cells.select(*dict.fromkeys([*group, *keys]), "_cells"), expected, group), "explained")
    different = staged(cells.select(*group, "_cells").distinct().withColumn("_row", F.monotonically_increasing_id()), "cells")
    numbers = sorted(r["tree"] for r in leaves.select("tree").distinct().collect())  # rounds, not rows
    # a condition of a leaf in numbers of thresholds: what is in a cell is above as many as its number
    place = lambda c, end: (F.array_position(F.get("edges", c["f"]), c[end]) - 1).cast("double")
    placed = F.transform("conditions", lambda c: F.struct(c["f"].alias("f"), place(c, "low").alias("low"), place(c, "high").alias("high"), c["share"].alias("share")))
    leaves = match(leaves, edges, group).withColumn("conditions", placed)
    entry = F.struct("value", "conditions")
    sums = None
    for at in range(0, len(numbers), TREES_AT_ONCE):
        some = leaves.where(F.col("tree").isin(numbers[at : at + TREES_AT_ONCE]) & (F.size("conditions") > 0))
        per_group = some.groupBy(*group, "tree").agg(F.collect_list(entry).alias("_leaves"))  # 2^depth of them at most
        met = match(different, staged(per_group, "leaves"), group).select("_row", "_cells", F.explode("_leaves").alias("_l"))
        o = F.transform(F.col("_l.conditions"), lambda c: F.struct(c["f"].alias("f"), _holds(c, F.get("_cells", c["f"])).alias("o"), c["share"].alias("z")))
        met = met.select("_row", F.col("_l.value").alias("_v"), o.alias("_c")).where("_v <> 0")
        part = met.select("_row", F.inline(_contributions(deepest))).groupBy("_row", "f").agg(F.sum("phi").alias("phi"))
        part = staged(part, "phi")
        sums = part if sums is None else staged(sums.unionByName(part).groupBy("_row", "f").agg(F.sum("phi").alias("phi")), "phi")
    if sums is None:
        values = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(0.0).alias("phi")) for f in number])
        return cells.select(*keys, F.inline(values), "expected").select(*keys, "feature", "phi", "expected")
    by_cell = sums.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("f", "phi"))).alias("_phi"))
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.try_element_at("_phi", F.lit(i)), F.lit(0.0)).alias("phi")) for f, i in number.items()])
    valued = staged(match(different, by_cell, ["_row"], "left").select(*group, "_cells", values.alias("_values")), "values")
    return match(cells, valued, [*group, "_cells"]).select(*keys, "expected", F.inline("_values")).select(*keys, "feature", "phi", "expected")


def _thresholds(model: GroupedTrees) -> DataFrame:
    """Group columns and ``edges``: the different thresholds of each feature, ascending."""
    found = model.trees.where(F.col("feature").isNotNull()).groupBy(*model.group, "feature").agg(F.array_sort(F.collect_set("threshold")).alias("ends"))
    by = found.groupBy(*model.group).agg(F.map_from_entries(F.collect_list(F.struct("feature", "ends"))).alias("by"))
    none = F.array().cast("array<double>")
    edges = F.array(*[F.coalesce(F.try_element_at("by", F.lit(f)), none) for f in model.features])
    return match(model.base, by, list(model.group), "left").select(*model.group, edges.alias("edges"))


def _contributions(deepest: int) -> Column:
    """For each feature f of a leaf: ``value (o_f - z_f) sum_s w(s) e_s``, where e_s is the sum over
    the sets of s other features of the product of their o and of the rest's z. The e_s are the
    coefficients of the product of ``z + o t`` over the other features, multiplied out one by one."""

    def others(f: Column) -> Column:
        rest = F.filter("_c", lambda c: c["f"] != f)

        def times(e: Column, c: Column) -> Column:
            grown = F.concat(e, F.array(F.lit(0.0)))
            return F.transform(grown, lambda x, i: x * c["z"] + F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0.0)) * c["o"])

        return F.aggregate(rest, F.array(F.lit(1.0)), times)

    weights = F.get(_weighted(deepest), F.size("_c") - 1)

    def phi(c: Column) -> Column:
        products = F.zip_with(others(c["f"]), weights, lambda e, w: e * w)
        total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        return F.struct(c["f"].alias("f"), (F.col("_v") * (c["o"] - c["z"]) * total).alias("phi"))

    return F.transform("_c", phi)


def shapley_ranks(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute value of each feature and its rank."""
    mean = phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("shap_importance"))
    place = Window.partitionBy(*by).orderBy(F.desc("shap_importance"), "feature")  # as many rows as features
    return mean.withColumn("rank", F.row_number().over(place))
