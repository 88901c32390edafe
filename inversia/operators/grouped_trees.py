"""Regression trees of many groups, grown together.

A group is whatever a model belongs to: a site, a target, a fold, a variant. All trees of all groups
grow level by level at the same time: one aggregate sums gradients and hessians per (group, node,
feature, bin), a window over the bins of a feature finds its best cut, and the best cut of each node
is the level's result. So the number of Spark jobs depends on rounds and depth, never on the number
of groups. Rows of small groups meet in one task and are summed there; a large group is one of many
in a map-side combined sum.

Values are replaced once by the numbers of their bins. Edges are read from counts per distinct
value, its leading ``bits`` at most, which are combined before they are shuffled; a group and
feature with no more different values than bins has an edge at each of them, so small trees are
exact. A row moves left where its bin is at most the split's; nulls are below all values.

Rows that are only to be predicted travel along: they add nothing to the sums and are updated like
the rest, so a fit returns the predictions of every row it was given.

Split choice: second-order gain, ``G^2 / (H + l2)`` of both sides less that of the whole. With
squared loss, no penalty and ``H`` the number of rows this is the usual reduction of variance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.plans.joins import match
from inversia.session import dropped, staged

#: A prediction over many trees is written down after so many of them.
TREES_AT_ONCE = 25
#: Trees are sent to every task up to so many bytes, at so many a node; larger tables of them are shuffled.
MOST_SENT, NODE_BYTES = 64 << 20, 64
#: A group of more cells (rows times features) is summed where its rows are before its cells meet; rows of
#: smaller ones are dealt to tasks of about so many cells.
MOST_CELLS, CELLS_PER_TASK = 1_000_000, 500_000
ROOT = 1


@dataclass(frozen=True)
class Growth:
    """Sizes of the trees. ``rows`` and ``columns`` are the shares drawn for each tree; ``least`` the
    rows (hessian, for logistic loss) that either side of a cut must keep; ``l2`` the penalty on
    leaves; ``bits`` how finely edges are placed (52: every double its own)."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least: float = 1.0
    least_gain: float = 0.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 64
    bits: int = 12
    seed: int = 42
    loss: str = "squared"


@dataclass(frozen=True)
class Sizes:
    """``sent``: a round's trees of all groups are few enough to be sent to every task. ``small_cells``:
    rows times features of all small groups. ``any_large``: whether a group is large."""

    sent: bool
    small_cells: int
    any_large: bool


@dataclass(frozen=True)
class GroupedTrees:
    """``trees``: group columns, ``tree``, ``node`` (the root is 1, children of n are 2n and 2n+1),
    ``feature`` and ``threshold`` (null in a leaf), ``gain``, ``cover`` (sum of hessians), ``value``
    (what a leaf adds to the prediction). ``base``: group columns and ``base``, the start. A tree's
    rate is in its leaves; a forest's are divided by their number, with the share in ``base``."""

    group: tuple[str, ...]
    features: tuple[str, ...]
    trees: DataFrame
    base: DataFrame
    loss: str = "squared"

    def importance(self) -> DataFrame:
        """``feature``, ``importance`` of every group: its share of all gains, unused features 0."""
        names = F.explode(F.array(*[F.lit(f) for f in self.features])).alias("feature")
        gains = self.trees.where(F.col("feature").isNotNull()).groupBy(*self.group, "feature").agg(F.sum("gain").alias("gain"))
        every = self.base.select(*self.group, names)
        joined = match(every, gains, [*self.group, "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        total = F.sum("gain").over(Window.partitionBy(*self.group))  # as many rows as features
        return joined.select(*self.group, "feature", F.coalesce(F.try_divide("gain", total), F.lit(0.0)).alias("importance"))

    def predict(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """``rows`` with a prediction each; null where the group has no model. Trees are joined by
        group, TREES_AT_ONCE at a time, and followed by comparisons of the row's own values."""
        out = match(rows, self.base.withColumnRenamed("base", "_sum"), list(self.group), "left")
        numbers = sorted(r["tree"] for r in self.trees.select("tree").distinct().collect())  # rounds, not rows
        levels = int(self.trees.agg(F.max(F.length(F.bin("node")))).first()[0] or 1) - 1
        values = F.create_map(*[x for f in self.features for x in (F.lit(f), F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")))])
        entry = F.struct("node", F.struct("feature", "threshold", "value"))
        for i, number in enumerate(numbers, 1):
            maps = self.trees.where(F.col("tree") == number).groupBy(*self.group).agg(F.map_from_entries(F.collect_list(entry)).alias("_tree"))
            out = match(out.withColumn("_x", values), maps, list(self.group), "left")

            def step(node: Column) -> Column:
                split = F.try_element_at("_tree", node)
                right = F.coalesce(F.try_element_at("_x", split["feature"]) > split["threshold"], F.lit(False)).cast("int")
                return F.when(split["feature"].isNull(), node).otherwise(node * 2 + right)

            leaf = F.try_element_at("_tree", _repeated(step, levels))["value"]
            out = out.withColumn("_sum", F.col("_sum") + F.coalesce(leaf, F.lit(0.0))).drop("_tree", "_x")
            if i % TREES_AT_ONCE == 0 and i < len(numbers):
                out = staged(out, "predicted")
        final = F.col("_sum") if self.loss == "squared" else 1 / (1 + F.exp(-F.col("_sum")))
        return out.withColumn(name, final).drop("_sum")


def _repeated(step: Callable[[Column], Column], times: int) -> Column:
    """``step`` applied to the root's number so many times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(ROOT), lambda node, _: step(node)) if times else F.lit(ROOT)


def bin_edges(rows: DataFrame, group: Sequence[str], features: Sequence[str], bins: int, bits: int) -> DataFrame:
    """Group columns and ``edges``: for each feature, in order, the ascending upper ends of its bins
    but the last. One row per group.

    A value's cell is the value cut to its leading ``bits``; cells are counted, and an edge is the
    largest value of a cell in which the count passes a multiple of ``n / bins``."""
    stacked = F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v")
    known = rows.select(*group, stacked).where("v IS NOT NULL AND NOT isnan(v)")
    # far from the ends of the doubles only; zero, infinities and the like are cells of their own
    plain = F.abs("v").between(1e-290, 1e290)
    scale = F.pow(F.lit(2.0), F.lit(float(bits)) - F.floor(F.log2(F.when(plain, F.abs("v")))))
    cell = F.col("v") if bits >= 52 else F.coalesce(F.floor(F.col("v") * scale).cast("double") / scale, F.col("v"))
    cells = known.withColumn("cell", cell).groupBy(*group, "f", "cell").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    ends = ends_of_bins(staged(cells, "cells"), group, bins)
    by_feature = ends.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("f", "ends"))).alias("by"))
    every = rows.select(*group).distinct()
    none = F.array().cast("array<double>")
    edges = F.array(*[F.coalesce(F.element_at("by", F.lit(i)), none) for i in range(len(features))])
    return match(every, by_feature, list(group), "left").select(*group, edges.alias("edges"))


def ends_of_bins(cells: DataFrame, group: Sequence[str], bins: int) -> DataFrame:
    """Of each group and feature (``f``) the ascending ``ends`` of its bins but the last, from counts
    (``n``) and largest values (``top``) of cells."""
    # cells of a feature of a group number 2^bits an octave at most, whatever its rows
    each = Window.partitionBy(*group, "f")
    upto = F.sum("n").over(each.orderBy("cell"))
    placed = cells.withColumns({"upto": upto, "total": F.sum("n").over(each), "cells": F.count("*").over(each)})
    steps = [F.floor(x * bins / F.col("total")) for x in (F.col("upto"), F.col("upto") - F.col("n"))]
    chosen = placed.where(((F.col("cells") <= bins) | (steps[0] > steps[1])) & (F.col("upto") < F.col("total")))
    return chosen.groupBy(*group, "f").agg(F.array_sort(F.collect_list("top")).alias("ends"))  # bins at most


def _binned(rows: DataFrame, edges: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``_bins``: the bin of every feature, 0 for null, 1 up to the first edge, and so on."""
    return with_places(rows, edges, group, features, "_bins", 1)


def with_places(rows: DataFrame, edges: DataFrame, group: Sequence[str], features: Sequence[str], name: str, first: int) -> DataFrame:
    """``name``: of each feature how many of its group's ``edges`` are below the value, plus ``first``;
    0 for null and NaN. ``edges``, a written table, is asked how many there are at most."""
    most = edges.agg(*[F.max(F.size(F.col("edges")[i])) for i in range(len(features))]).first()
    values = [F.col(f).cast("double") for f in features]
    # a projection of its own: the search reads a value once a step
    out = match(rows.withColumns({f"_v{i}": F.when(~F.isnan(v), v) for i, v in enumerate(values)}), edges.withColumnRenamed("edges", "_edges"), list(group), "left")

    def place(i: int) -> Column:
        value = F.col(f"_v{i}")
        # by halves, as many as the longest list needs
        halves = F.array(*[F.lit(1 << k) for k in reversed(range((most[i] or 0).bit_length()))]).cast("array<int>")
        below = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get(F.col("_edges")[i], at + step - 1) < value, step).otherwise(0))
        return F.when(value.isNull(), 0).otherwise(below + first).cast("int")

    return out.withColumn(name, F.array(*[place(i) for i in range(len(features))])).drop("_edges", *[f"_v{i}" for i in range(len(features))])


def _below(splits: Column, node: Column) -> Column:
    """The child of ``node`` that a row belongs to; the node itself if it is no split."""
    split = F.try_element_at(splits, node)
    return F.coalesce(node * 2 + (F.col("_bins")[split["f"]] > split["cut"]).cast("int"), node)


def _walk(levels: int) -> Column:
    """The node where a row stands after ``levels`` levels of its group's splits (``_splits``)."""
    return _repeated(lambda node: _below(F.col("_splits"), node), levels)


def _grow(rows: DataFrame, keys: Sequence[str], growth: Growth, sizes: Sizes, trees: int = 1) -> DataFrame:
    """One tree per key: ``keys``, ``node``, ``f``, ``cut``, ``gain``, ``g``, ``h`` (f null in leaves).

    ``rows``: keys, ``_bins``, ``_g``, ``_h``, ``_large``, only those that are learned from. Rows of
    small groups are brought together once a level, one row for all its features, and summed there;
    large groups send sums."""
    nodes: list[DataFrame] = []
    for level in range(growth.depth):
        placed = rows.withColumn("node", F.lit(ROOT))
        if nodes:
            maps = _split_maps(reduce(DataFrame.unionByName, nodes), keys)
            placed = match(rows, F.broadcast(maps) if sizes.sent else maps, list(keys), "left").withColumn("node", _walk(level))
            placed = placed.where(F.col("node") >= 1 << level)  # others have come to a leaf
        parts = []
        if sizes.small_cells:
            tasks = 1 + sizes.small_cells * trees // CELLS_PER_TASK
            parts.append(placed.where("NOT _large").select(*keys, "node", "_g", "_h", "_bins").repartition(tasks, *keys))
        if sizes.any_large or not parts:
            parts.append(placed.where("_large"))
        chosen = reduce(DataFrame.unionByName, [_best_cuts(part, keys, growth) for part in parts])
        chosen = staged(chosen, "level")
        nodes.append(chosen.select(*keys, "node", (-F.col("best.f")).alias("f"), (-F.col("best.cut")).alias("cut"), F.col("best.gain").alias("gain"), F.col("ga").alias("g"), F.col("ha").alias("h")))
    # the children of the last level's splits are leaves; their sums are known
    sides = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("best.gl").alias("g"), F.col("best.hl").alias("h")),
        F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("ga") - F.col("best.gl")).alias("g"), (F.col("ha") - F.col("best.hl")).alias("h")),
    )
    ends = chosen.where("best IS NOT NULL").select(*keys, F.inline(sides))
    unknown = [F.lit(None).cast(t).alias(c) for c, t in (("f", "int"), ("cut", "int"), ("gain", "double"))]
    return reduce(DataFrame.unionByName, [*nodes, ends.select(*keys, "node", *unknown, "g", "h")])


def _best_cuts(placed: DataFrame, keys: Sequence[str], growth: Growth) -> DataFrame:
    """Of every node its sums and its best cut, if one is allowed."""
    drawn = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col("f"), F.lit(growth.seed)), F.lit(1000)) < int(growth.columns * 1000)
    cells = placed.select(*keys, "node", "_g", "_h", F.posexplode("_bins").alias("f", "bin"))
    cells = cells.groupBy(*keys, "node", "f", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
    each = Window.partitionBy(*keys, "node", "f")  # as many rows as bins
    left = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cells.withColumns({"gl": F.sum("g").over(left), "hl": F.sum("h").over(left), "ga": F.sum("g").over(each), "ha": F.sum("h").over(each)})
    gl, hl, ga, ha = (F.col(c) for c in ("gl", "hl", "ga", "ha"))
    gain = _part(gl, hl, growth) + _part(ga - gl, ha - hl, growth) - _part(ga, ha, growth)
    found = found.withColumn("gain", gain)
    allowed = (hl >= growth.least) & (ha - hl >= growth.least) & (F.col("gain") > max(growth.least_gain, 0.0))
    if growth.columns < 1:
        allowed = allowed & drawn
    # the largest gain as a single, so that the order of a sum decides nothing; of equals the first feature, then the lowest cut
    best = F.struct(F.col("gain").cast("float").alias("about"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("cut"), "gain", "gl", "hl")
    return found.groupBy(*keys, "node").agg(F.max(F.when(allowed, best)).alias("best"), *[F.max(F.when(F.col("f") == 0, F.col(x))).alias(x) for x in ("ga", "ha")])


def _part(g: Column, h: Column, growth: Growth) -> Column:
    return F.try_divide(g * g, h + F.lit(growth.l2))


def _split_maps(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    splits = nodes.where(F.col("f").isNotNull())
    return splits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("f", "cut")))).alias("_splits"))


def _tree_maps(nodes: DataFrame, keys: Sequence[str], growth: Growth, share: float) -> DataFrame:
    """``_splits`` and ``_leaves`` of each key's tree, as maps by node: 2^(depth + 1) entries at most."""
    split = F.when(F.col("f").isNotNull(), F.struct("node", F.struct("f", "cut")))
    leaf = F.when(F.col("f").isNull(), F.struct("node", _leaf(growth, share)))
    entries = [F.map_from_entries(F.collect_list(e)).alias(n) for e, n in ((split, "_splits"), (leaf, "_leaves"))]
    return nodes.groupBy(*keys).agg(*entries)


def _leaf(growth: Growth, share: float) -> Column:
    """What a leaf adds: the Newton step, times the rate or a tree's share."""
    return -F.try_divide(F.col("g"), F.col("h") + F.lit(growth.l2)) * F.lit(share)


def _named(nodes: DataFrame, edges: DataFrame, group: Sequence[str], features: Sequence[str], growth: Growth, share: float) -> DataFrame:
    """Splits with the names of their features and the values they cut at."""
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    # bin 0 holds nulls only: any value is above
    at = F.when(F.col("cut") == 0, F.lit(float("-inf"))).otherwise(F.try_element_at(F.col("edges")[F.col("f")], F.greatest("cut", F.lit(1))))
    named = match(nodes, edges, list(group), "left")
    leaf = F.col("f").isNull()
    return named.select(
        *group, "tree", "node", F.when(~leaf, name).alias("feature"), F.when(~leaf, at).alias("threshold"), "gain", F.col("h").alias("cover"), F.when(leaf, _leaf(growth, share)).alias("value")
    )


def _ready(rows: DataFrame, group: Sequence[str], features: Sequence[str], label: str, learn: Column, growth: Growth, trees: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, Sizes]:
    """Rows with bins, label (null where not learned from), start and whether their group is large,
    written once; edges; starts; what the groups' sizes decide."""
    marked = rows.withColumn("_y", F.when(learn, F.col(label).cast("double")))
    marked = marked.withColumn("_y", F.when(~F.isnan("_y"), F.col("_y")))
    seen = marked.where(F.col("_y").isNotNull())
    edges = staged(bin_edges(seen, group, features, growth.bins, growth.bits), "edges")
    mean = F.avg("_y")
    if growth.loss == "logistic":
        # kept off 0 and 1, where the start would be infinite
        mean = F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))
        mean = F.log(mean / (1 - mean))
    large = (F.count("*") * len(features) > MOST_CELLS).alias("_large")
    counted = staged(seen.groupBy(*group).agg(mean.alias("base"), large, F.count("*").alias("_n")), "base")
    base = counted.select(*group, "base")
    binned = match(_binned(marked, edges, group, features), counted.drop("_n").withColumnRenamed("base", "_p"), list(group), "left")
    groups, small, any_large = counted.agg(F.count("*"), F.sum(F.when(~F.col("_large"), F.col("_n"))), F.max("_large")).first()
    sizes = Sizes(groups * trees * NODE_BYTES << (growth.depth + 1) <= MOST_SENT, (small or 0) * len(features), bool(any_large))
    return staged(binned, "binned"), edges, base, sizes


def fit_boosted(
    rows: DataFrame, group: Sequence[str], features: Sequence[str], label: str, keys: Sequence[str], learn: Column | None = None, growth: Growth = Growth()
) -> tuple[GroupedTrees, DataFrame]:
    """Second-order boosting of every group, and all ``rows`` with ``prediction``.

    ``learn`` marks the rows to learn from (default: those with a label; a null label is never
    learned from). ``keys`` identify a row in the draws of rows. Groups without a row to learn from
    have no model and null predictions. A group whose label doesn't vary keeps its start. Each round
    is ``depth + 1`` aggregates over the binned rows and, but for the last, one rewrite of them."""
    models, out = fit_variants(rows, group, features, label, keys, learn, {"prediction": growth})
    return models["prediction"], out


def fit_variants(
    rows: DataFrame, group: Sequence[str], features: Sequence[str], label: str, keys: Sequence[str], learn: Column | None, growths: dict[str, Growth]
) -> tuple[dict[str, GroupedTrees], DataFrame]:
    """Several boosted models of every group over the same rows, and the rows with a column of
    predictions by each one's name. Edges and bins, which they share, are made once."""
    shared = {(g.bins, g.bits, g.loss) for g in growths.values()}
    if len(shared) != 1:
        raise ValueError("variants differ in bins, bits or loss")
    first = next(iter(growths.values()))
    if first.loss not in ("squared", "logistic"):
        raise ValueError(f"unknown loss {first.loss}")
    group = tuple(group)
    wanted = F.col(label).isNotNull() & (F.lit(True) if learn is None else learn)
    deepest = replace(first, depth=max(g.depth for g in growths.values()))
    held, edges, base, sizes = _ready(rows, group, features, label, wanted, deepest)
    state = held.withColumnRenamed("_p", "_start")
    models = {}
    last = next((name, growth.rounds - 1) for name, growth in reversed(growths.items()))
    for name, growth in growths.items():
        state = state.withColumn("_p", F.col("_start"))
        fitted: list[DataFrame] = []
        for tree in range(growth.rounds):
            p = F.col("_p") if growth.loss == "squared" else 1 / (1 + F.exp(-F.col("_p")))
            h = F.lit(1.0) if growth.loss == "squared" else p * (1 - p)
            seen = state.where(F.col("_y").isNotNull())
            if growth.rows < 1:
                draw = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(tree), F.lit(growth.seed)), F.lit(1000))
                seen = seen.where(draw < int(growth.rows * 1000))
            learned = seen.select(*group, F.lit(tree).alias("tree"), "_bins", "_large", (p - F.col("_y")).alias("_g"), h.alias("_h"))
            nodes = staged(_grow(learned, [*group, "tree"], growth, sizes), "tree")
            maps = _tree_maps(nodes, group, growth, growth.rate)
            placed = match(state, F.broadcast(maps) if sizes.sent else maps, list(group), "left")
            moved = F.col("_p") + F.coalesce(F.try_element_at("_leaves", _walk(growth.depth)), F.lit(0.0))
            state = placed.withColumn("_p", moved).drop("_splits", "_leaves")
            if (name, tree) != last:  # what comes last is for the caller, who may need few columns or none
                state = staged(state, "round")
                dropped(held)  # one table of rows is kept, whatever the rounds
                held = state
            fitted.append(_named(nodes, edges, group, features, growth, growth.rate))
        trees = staged(reduce(DataFrame.unionByName, fitted), "trees")
        models[name] = GroupedTrees(group, tuple(features), trees, base, growth.loss)
        state = state.withColumn(name, F.col("_p") if growth.loss == "squared" else 1 / (1 + F.exp(-F.col("_p")))).drop("_p")
    return models, state.drop("_start", "_y", "_bins", "_large")


def fit_forests(
    rows: DataFrame, group: Sequence[str], features: Sequence[str], label: str, keys: Sequence[str], learn: Column | None = None, trees: int = 100, growth: Growth = Growth(depth=10, least=2.0, l2=0.0)
) -> tuple[GroupedTrees, DataFrame]:
    """A forest for every group, all trees of all groups at once, and all ``rows`` with ``prediction``.

    Each tree sees every row a Poisson(1) number of times, drawn by hash of ``keys``; with one tree
    every row once. Squared loss; a group's prediction is the mean of its trees."""
    group = tuple(group)
    growth = replace(growth, loss="squared")
    wanted = F.col(label).isNotNull() & (F.lit(True) if learn is None else learn)
    state, edges, base, sizes = _ready(rows, group, features, label, wanted, growth, trees)
    number = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    seen = state.where(F.col("_y").isNotNull()).withColumn("tree", number)
    unit = (F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col("tree"), F.lit(growth.seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    # Poisson by its cumulative probabilities: e^-1, 2 e^-1, 2.5 e^-1, ...
    times, reached, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        reached += term
        times = times + (unit > reached).cast("int")
        term /= k
    weight = F.lit(1) if trees == 1 else times
    seen = seen.withColumn("_w", weight.cast("double")).where("_w > 0")
    learned = seen.select(*group, "tree", "_bins", "_large", ((F.col("_p") - F.col("_y")) * F.col("_w")).alias("_g"), F.col("_w").alias("_h"))
    nodes = staged(_grow(learned, [*group, "tree"], growth, sizes, trees), "forest")
    # a row meets its group's trees at once and adds them up where it is
    maps = _tree_maps(nodes, [*group, "tree"], growth, 1 / trees)
    forests = staged(maps.groupBy(*group).agg(F.collect_list(F.struct("_splits", "_leaves")).alias("_forest")), "forest")
    placed = match(state, F.broadcast(forests) if sizes.sent else forests, list(group), "left")

    def added(total: Column, tree: Column) -> Column:
        leaf = _repeated(lambda node: _below(tree["_splits"], node), growth.depth)
        return total + F.coalesce(F.try_element_at(tree["_leaves"], leaf), F.lit(0.0))

    total = F.coalesce(F.aggregate("_forest", F.lit(0.0), added), F.lit(0.0))
    out = placed.withColumn("prediction", F.col("_p") + total).drop("_p", "_y", "_bins", "_large", "_forest")
    named = staged(_named(nodes, edges, group, features, growth, 1 / trees), "trees")
    return GroupedTrees(group, tuple(features), named, base), out
