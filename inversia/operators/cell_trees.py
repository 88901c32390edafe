"""Boosted regression trees of several variants and folds, grown over cells of rows.

Trees compare a value with the edges of its bins, so rows whose values all lie in the same bins, a
cell, go the same way in every tree and have one prediction. What a squared loss needs of them is how
many they are and the sum of their labels. The rows are read a fixed number of times to find edges,
bins and cells; then each model of a variant and fold grows all its trees in a task of its own, over
arrays of cells. A variant that draws rows has them drawn one by one, for some trees at a time, by
tasks that keep a part of the cells, and its models are sent the drawn counts and sums.

The cells of all rows must fit a task (``MOST_BYTES``); a table with more of them isn't grown here.
Trees are those of Spark's boosting: the first one is fitted to the labels, later ones to twice the
rest, times the step size; a node is cut where the variance falls most. Edges are the same for all
folds, they come from all training rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inversia.operators.grouped_trees import ends_of_bins
from inversia.operators.modeling import with_folds
from inversia.plans.series import SeriesSpec
from inversia.session import dropped, scratch_path, staged

#: Cells of a table may take so many bytes: a byte a feature, a count and a sum a fold.
MOST_BYTES = 64 << 20
#: Edges are placed by the leading bits of a value.
EDGE_BITS = 16
#: Rows of the cells that a task draws from, and rows that it holds at once.
ROWS_PER_TASK = ROWS_AT_ONCE = 2_000_000
#: Drawn counts that a model is sent at once: trees times cells.
DRAWN_AT_ONCE, MOST_TREES = 8_000_000, 25
#: Cells in one row of drawn counts, and rows in one row of packed ones.
CELLS_A_ROW, PACKED_A_ROW = 4_000, 50_000
LANES = 4  # draws of 16 bits from one hash

EDGES = "f int, cell double, top double, n bigint"
BINNED = "fold int, _cell binary, label double, h bigint"
PACKED = "cell binary, fold binary, label binary, h binary"
COUNTED = "_cell binary, fold int, n bigint, s double"
FED = "model int, ids binary, n binary, s binary, state binary"
GROWN = "model int, tree int, node int, feature int, cut int, gain double, n double, total double, value double, below int, state binary"


@dataclass(frozen=True)
class Cells:
    """``bins``: a row a feature, a column a cell. ``n``, ``s``: rows and label sums, a row a fold."""

    bins: np.ndarray
    widths: tuple[int, ...]
    n: np.ndarray
    s: np.ndarray

    def seen(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """What the model that is fitted on all folds but this one sees; -1 leaves out none."""
        kept = np.arange(len(self.n)) != fold
        return self.n[kept].sum(0), self.s[kept].sum(0)


@dataclass(frozen=True)
class Variant:
    """What a model needs of its estimator."""

    rounds: int
    depth: int
    rate: float
    rows: float
    columns: int
    seed: int


# -- one model ---------------------------------------------------------------------------------


def grow_tree(cells: Cells, n: np.ndarray, total: np.ndarray, depth: int, columns: int, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A tree over cells of ``n`` rows with ``total`` of what is fitted, and each cell's node.

    Nodes are numbered from 0, level by level; the children of a node are ``below`` and the next
    one. ``cut`` is the last bin on the left. Of equal gains the first feature and lowest cut win."""
    d, size = cells.bins.shape
    most = 2 ** (depth + 1)
    feature, cut, below = np.full(most, -1), np.zeros(most, np.int64), np.full(most, -1)
    gain, node_n, node_total = np.full(most, -1.0), np.zeros(most), np.zeros(most)
    at, place = np.zeros(size, np.int64), np.empty(size, np.int64)
    node_n[0], node_total[0] = n.sum(), total.sum()
    active, count, every, flat = np.zeros(1, np.int64), 1, np.arange(size), cells.bins.ravel()
    for _ in range(depth):
        a = len(active)
        relative = np.full(most, a)
        relative[active] = np.arange(a)
        inside = relative.take(at)
        allowed = np.ones((a, d), bool) if columns >= d else rng.random((a, d)).argsort(1).argsort(1) < columns
        best = np.zeros(a, np.float32)
        found = {"f": np.full(a, -1), "cut": np.zeros(a, np.int64), "gain": np.zeros(a), "n": np.zeros(a), "t": np.zeros(a)}
        nt, tt = node_n[active], node_total[active]
        for f in range(d):
            width = cells.widths[f]
            if width < 2:
                continue
            np.multiply(inside, width, out=place)
            place += cells.bins[f]
            nl, tl = (np.bincount(place, w, (a + 1) * width)[: a * width].reshape(a, width).cumsum(1)[:, :-1] for w in (n, total))
            nr, tr = nt[:, None] - nl, tt[:, None] - tl
            may = (nl > 0.5) & (nr > 0.5) & allowed[:, f, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(may, (tl * tl / nl + tr * tr / nr - (tt * tt / nt)[:, None]) / nt[:, None], 0.0)
            # as singles, so that the order of a sum decides nothing
            about = gains.astype(np.float32)
            where = about.argmax(1)
            here = np.arange(a), where
            better = about[here] > best
            best[better] = about[here][better]
            for name, values in (("f", np.full(a, f)), ("cut", where), ("gain", gains[here]), ("n", nl[here]), ("t", tl[here])):
                found[name][better] = values[better]
        split = found["f"] >= 0
        if not split.any():
            break
        chosen = active[split]
        left = count + 2 * np.arange(len(chosen))
        feature[chosen], cut[chosen], gain[chosen], below[chosen] = found["f"][split], found["cut"][split], found["gain"][split], left
        node_n[left], node_total[left] = found["n"][split], found["t"][split]
        node_n[left + 1], node_total[left + 1] = node_n[chosen] - node_n[left], node_total[chosen] - node_total[left]
        # those that stood on a node of this level go on, others stay: no bin is above 255
        after, row, limit = np.arange(most), np.zeros(most, np.int64), np.full(most, 255, np.uint8)
        after[chosen], row[chosen], limit[chosen] = left, feature[chosen] * size, cut[chosen]
        np.add(row.take(at), every, out=place)
        right = flat.take(place) > limit.take(at)
        at = after.take(at)
        at += right
        active = np.concatenate([left, left + 1])
        active.sort()
        count += 2 * len(chosen)
    value = np.divide(node_total, node_n, out=np.zeros(most), where=node_n > 0)
    tree = {"feature": feature, "cut": cut, "gain": gain, "n": node_n, "total": node_total, "value": value, "below": below}
    return {k: v[:count] for k, v in tree.items()}, at


def boost(cells: Cells, variant: Variant, fold: int, first: int, last: int, state: np.ndarray | None, draws: Callable[[int], tuple[np.ndarray, np.ndarray]] | None) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
    """Trees ``first`` to ``last`` of a model and its prediction of every cell after them."""
    p = np.zeros(cells.bins.shape[1]) if state is None else state.copy()
    seen = cells.seen(fold)
    if not seen[0].sum():
        raise ValueError("no rows to learn from")
    trees = []
    for tree in range(first, last):
        n, s = seen if draws is None else draws(tree)
        rest = s if tree == 0 else 2 * (s - n * p)
        rng = np.random.default_rng([variant.seed & 0xFFFFFFFF, tree])
        grown, at = grow_tree(cells, n.astype(np.float64), rest, variant.depth, variant.columns, rng)
        p += ((1.0 if tree == 0 else variant.rate) * grown["value"]).take(at)
        trees.append(grown)
    return trees, p


# -- what Spark does -----------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int, learned: bool = True) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d) + 0.0
    if learned and not np.isfinite(x).all():
        raise ValueError("features must be finite")
    return x


def _places(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A byte a feature: how many edges are below the value, plus one. NaN is above all."""
    cell = np.empty(x.shape, np.uint8)
    for f, ends in enumerate(edges):
        cell[:, f] = np.searchsorted(ends, x[:, f]) + 1
    return cell


def _names(bins: np.ndarray) -> np.ndarray:
    """Cells, a row each, as values that can be sorted."""
    return np.ascontiguousarray(bins).view(f"S{bins.shape[1]}").ravel()


def _edges(train: DataFrame, d: int, bins: int) -> tuple[list[np.ndarray], int]:
    """The ends of each feature's bins, and how many rows there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = [{"cell": np.empty(0), "top": np.empty(0), "n": np.empty(0, np.int64)} for _ in range(d)]
        waiting: list[np.ndarray] = []

        def settle() -> None:
            x = np.concatenate(waiting)
            waiting.clear()
            for f in range(d):
                v = np.sort(x[:, f])
                cut = (v.view(np.int64) & ~((1 << (52 - EDGE_BITS)) - 1)).view(np.float64)
                start = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
                h = held[f]
                cell = np.concatenate([h["cell"], cut[start]])
                top = np.concatenate([h["top"], np.maximum.reduceat(v, start)])
                n = np.concatenate([h["n"], np.diff(np.r_[start, len(v)])])
                order = np.argsort(cell, kind="stable")
                cell, top, n = cell[order], top[order], n[order]
                start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                held[f] = {"cell": cell[start], "top": np.maximum.reduceat(top, start), "n": np.add.reduceat(n, start)}

        for batch in batches:
            if batch.num_rows:
                waiting.append(_matrix(batch.column(0), d))
            if sum(len(x) for x in waiting) * d > 4_000_000:
                settle()
        if waiting:
            settle()
        for f, h in enumerate(held):
            if len(h["n"]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h["n"]), f, np.int32)), pa.array(h["cell"]), pa.array(h["top"]), pa.array(h["n"])], names=["f", "cell", "top", "n"])

    cells = train.select(vector_to_array("features").alias("x")).mapInArrow(counted, EDGES)
    cells = staged(cells.groupBy("f", "cell").agg(F.max("top").alias("top"), F.sum("n").alias("n")), "cells")
    ends = {r["f"]: r["ends"] for r in ends_of_bins(cells, (), bins).collect()}
    rows = cells.where("f = 0").agg(F.sum("n")).first()[0] or 0
    return [np.array(ends.get(f, []), np.float64) for f in range(d)], rows


def _binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``BINNED`` of rows with ``fold``, ``x``, ``label`` and ``h``; a cell is a byte a feature."""
    d = len(edges)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label = _matrix(batch.column(1), d), batch.column(2).to_numpy(zero_copy_only=False)
            if not np.isfinite(label).all():
                raise ValueError("labels must be finite")
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(_places(x, edges)), pa.array(label), batch.column(3)], names=["fold", "_cell", "label", "h"])

    return rows.mapInArrow(placed, BINNED)


def _binary(cell: np.ndarray) -> pa.Array:
    """A binary value a row of bytes."""
    size, d = cell.shape
    offsets = pa.py_buffer(np.arange(0, (size + 1) * d, d, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), size, [None, offsets, pa.py_buffer(np.ascontiguousarray(cell))])


def _bytes(cell: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(cell.buffers()[2], np.uint8)[cell.offset * d : (cell.offset + len(cell)) * d].reshape(-1, d)


def _packed(rows: DataFrame, d: int) -> DataFrame:
    """``PACKED``: many rows of ``BINNED`` in one, so that to read them again costs little."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> pa.RecordBatch:
            columns = [np.concatenate([_bytes(b.column(1), d) for b in held])]
            for i, kind in ((0, np.int16), (2, np.float64), (3, np.int64)):
                columns.append(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]).astype(kind))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["cell", "fold", "label", "h"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED_A_ROW:
                yield settle()
        if held:
            yield settle()

    return rows.mapInArrow(packed, PACKED)


def _unpacked(batch: pa.RecordBatch, d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cells, folds, labels and hashes of each packed row."""
    for row in zip(*[batch.column(i) for i in range(4)]):
        cell, *others = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.uint8, np.int16, np.float64, np.int64)))
        yield cell.reshape(-1, d), *others


def _runs(cell: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Where another cell or fold begins."""
    return np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1) | (fold[1:] != fold[:-1])])


def _counts(rows: DataFrame, d: int) -> DataFrame:
    """``COUNTED``: rows and label sums of every cell and fold."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, fold, y, _ in _unpacked(batch, d):
                start = _runs(cell, fold)
                n = np.diff(np.r_[start, len(y)])
                yield pa.RecordBatch.from_arrays([_binary(cell[start]), pa.array(fold[start].astype(np.int32)), pa.array(n), pa.array(np.add.reduceat(y, start))], names=["_cell", "fold", "n", "s"])

    return rows.mapInArrow(counted, COUNTED).groupBy("_cell", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _table(counts: DataFrame, widths: tuple[int, ...], folds: int) -> Cells:
    found, d = counts.toArrow().combine_chunks(), len(widths)
    packed = np.frombuffer(b"".join(found.column("_cell").to_pylist()), np.uint8).reshape(-1, d)
    names, place = np.unique(_names(packed), return_inverse=True)
    n, s = np.zeros((folds, len(names))), np.zeros((folds, len(names)))
    fold = found.column("fold").to_numpy()
    n[fold, place], s[fold, place] = found.column("n").to_numpy(), found.column("s").to_numpy()
    return Cells(np.ascontiguousarray(names.view(np.uint8).reshape(-1, d).T) - 1, widths, n, s)


def _hashed(h: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """64 bits a row, other ones for each draw."""
    z = h.view(np.uint64) + np.uint64(((draw + 1) * 0x9E3779B97F4A7C15 + seed) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _drawn(rows: DataFrame, shared, variant: Variant, folds: tuple[int, ...], first: int, last: int) -> DataFrame:
    """``FED``: of the trees ``first`` to ``last`` the drawn rows and label sums of cells, for the model of each fold."""
    limit = round(variant.rows * (1 << 16))

    def sums(packed: np.ndarray, fold: np.ndarray, y: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        every = len(cells.n)
        start = _runs(packed, fold)  # rows come sorted by cell and fold
        known, place = np.unique(np.searchsorted(_names(cells.bins.T + 1), _names(packed[start])), return_inverse=True)
        at = (fold[start], place)
        n, s = np.zeros((last - first, every, len(known)), np.int32), np.zeros((last - first, every, len(known)))
        for tree in range(first, last):
            if tree == first or tree % LANES == 0:
                bits = _hashed(h, tree // LANES, variant.seed).view(np.uint16).reshape(-1, LANES)
            mask = bits[:, tree % LANES] < limit
            np.add.at(n[tree - first], at, np.add.reduceat(mask, start, dtype=np.int32))
            np.add.at(s[tree - first], at, np.add.reduceat(y * mask, start))
        for model, left_out in enumerate(folds):
            kept = np.arange(every) != left_out
            for lo in range(0, len(known), CELLS_A_ROW):
                part = slice(lo, lo + CELLS_A_ROW)
                fed = [known[part].astype(np.int32), n[:, kept, part].sum(1, dtype=np.int32), s[:, kept, part].sum(1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in fed], pa.array([None], pa.binary())], names=["model", "ids", "n", "s", "state"]
                )

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(shared.value.bins)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.extend(_unpacked(batch, d))
            if sum(len(x[0]) for x in held) >= ROWS_AT_ONCE:
                yield from sums(*[np.concatenate(c) for c in zip(*held)])
                held.clear()
        if held:
            yield from sums(*[np.concatenate(c) for c in zip(*held)])

    return rows.mapInArrow(drawn, FED)


def _grown(fed: DataFrame, shared, variants: list[tuple[Variant, int]], first: int, last: int) -> DataFrame:
    """``GROWN``: a model's trees, if it is of all folds, and its predictions of all cells as ``state``."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        size, told = cells.bins.shape[1], {}
        for batch in batches:
            for model, ids, n, s, state in zip(*[batch.column(i) for i in range(5)]):
                mine = told.setdefault(model.as_py(), {})
                if state.is_valid:
                    mine["state"] = np.frombuffer(state.as_buffer(), np.float64)
                if ids.is_valid:
                    if "n" not in mine:
                        mine["n"], mine["s"] = np.zeros((last - first, size), np.int32), np.zeros((last - first, size))
                    at = np.frombuffer(ids.as_buffer(), np.int32)
                    mine["n"][:, at] += np.frombuffer(n.as_buffer(), np.int32).reshape(last - first, -1)
                    mine["s"][:, at] += np.frombuffer(s.as_buffer(), np.float64).reshape(last - first, -1)
        for model, mine in told.items():
            variant, fold = variants[model]
            draws = (lambda tree, m=mine: (m["n"][tree - first], m["s"][tree - first])) if "n" in mine else None
            trees, p = boost(cells, variant, fold, first, last, mine.get("state"), draws)
            names = ["feature", "cut", "gain", "n", "total", "value", "below"]
            types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            for tree, nodes in enumerate(trees if fold < 0 else [], first):
                many = len(nodes["n"])
                made = [pa.array(np.full(many, x), pa.int32()) for x in (model, tree)] + [pa.array(np.arange(many), pa.int32())]
                made += [pa.array(nodes[c].astype(t.to_pandas_dtype())) for c, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*made, pa.nulls(many, pa.binary())], names=["model", "tree", "node", *names, "state"])
            empty = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), *types)]
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), *empty, pa.array([p.tobytes()], pa.binary())], names=["model", "tree", "node", *names, "state"])

    return fed.repartitionById(len(variants), "model").mapInArrow(grow, GROWN)


def _fit(rows: DataFrame, shared, variant: Variant, folds: tuple[int, ...]) -> list[DataFrame]:
    """The model of every fold, in pieces of ``GROWN``; the last one has the final predictions."""
    spark, models = rows.sparkSession, [(variant, k) for k in folds]
    none = spark.range(len(models)).select(F.col("id").cast("int").alias("model"), *[F.lit(None).cast("binary").alias(c) for c in ("ids", "n", "s", "state")])
    if variant.rows >= 1:
        return [staged(_grown(none, shared, models, 0, variant.rounds), "grown")]
    trees = max(1, min(MOST_TREES, DRAWN_AT_ONCE // max(shared.value.bins.shape[1], 1)))
    out: list[DataFrame] = []
    for first in range(0, variant.rounds, trees):
        last = min(first + trees, variant.rounds)
        fed = none.unionByName(_drawn(rows, shared, variant, folds, first, last))
        if out:
            fed = fed.unionByName(out[-1].where("state IS NOT NULL").select("model", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "n", "s")], "state"))
        out.append(staged(_grown(fed, shared, models, first, last), "grown"))
    return out


def _model(spark: SparkSession, estimator: GBTRegressor, grown: list[DataFrame], edges: list[np.ndarray], variant: Variant) -> GBTRegressionModel:
    """The trees as Spark's own model, by way of its file format. The spread within a node isn't known."""
    path, ends = scratch_path(spark, "model"), spark.sparkContext.broadcast(edges)

    threshold = F.udf(lambda f, cut: float(ends.value[f][cut]) if f >= 0 else None, "double")

    inner, unknown = F.col("feature") >= 0, F.lit(float("nan"))
    right = F.when(inner, F.col("below") + 1).otherwise(-1)
    at = F.when(inner, F.array(threshold("feature", "cut"))).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), at.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    fields = {"id": F.col("node"), "prediction": F.col("value"), "impurity": unknown, "impurityStats": F.array("n", "total", unknown), "rawCount": F.col("n").cast("bigint")}
    fields |= {"gain": F.col("gain"), "leftChild": F.col("below"), "rightChild": right, "split": split}
    node = F.struct(*[c.alias(n) for n, c in fields.items()])
    parts = [g.where("state IS NULL") for g in grown]
    reduce(DataFrame.unionByName, parts).select(F.col("tree").alias("treeID"), node.alias("nodeData")).coalesce(1).write.parquet(f"{path}/data")
    params, usual = ({p.name: v for p, v in found.items()} for found in (estimator._paramMap, estimator._defaultParamMap))
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    of_tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "paramMap": {"maxDepth": variant.depth}, "defaultParamMap": {}}
    described = [(i, json.dumps({**of_tree, "uid": f"{estimator.uid}_{i}"}), 1.0 if i == 0 else variant.rate) for i in range(variant.rounds)]
    spark.createDataFrame(described, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {"class": "org.apache.spark.ml.regression.GBTRegressionModel", **about, "uid": estimator.uid, "paramMap": params, "defaultParamMap": usual, "numFeatures": len(edges), "numTrees": variant.rounds}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTRegressionModel.load(path)


def walk(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node at which each cell, a column of ``bins``, ends."""
    at, every = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    while (inner := tree["feature"][at] >= 0).any():
        right = bins[tree["feature"][at], every] > tree["cut"][at]
        at = np.where(inner, tree["below"][at] + right, at)
    return at


def _predictor(shared, edges: list[np.ndarray], variants: dict[str, Variant], grown: dict[str, list[DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """Rows (``features`` and other columns) to the other columns and ``_p_<variant>``. Cells of
    training rows have their predictions; others go through the trees."""
    spark, names, known, trees = grown[next(iter(grown))][0].sparkSession, list(variants), [], []
    for name in names:
        known.append(np.frombuffer(grown[name][-1].where("model = 0 AND state IS NOT NULL").first()["state"], np.float64))
        by: dict[int, dict[str, np.ndarray]] = {}
        for part in grown[name]:
            nodes = part.where("state IS NULL").select("tree", "node", "feature", "cut", "below", "value").orderBy("tree", "node").toArrow()
            columns = {c: nodes.column(c).to_numpy() for c in nodes.column_names}
            start = np.flatnonzero(columns["node"] == 0)
            for lo, hi in zip(start, [*start[1:], len(columns["node"])]):
                by[int(columns["tree"][lo])] = {c: columns[c][lo:hi] for c in ("feature", "cut", "below", "value")}
        trees.append([by[t] for t in sorted(by)])
    told = spark.sparkContext.broadcast((known, trees))
    rates, d = [v.rate for v in variants.values()], len(edges)

    def scores(cell: np.ndarray) -> list[np.ndarray]:
        every = _names(shared.value.bins.T + 1)
        found, place = np.unique(_names(cell), return_inverse=True)
        at = np.searchsorted(every, found).clip(max=len(every) - 1)
        new = every[at] != found
        bins = np.ascontiguousarray(found[new].view(np.uint8).reshape(-1, d).T) - 1
        out = []
        for values, grown_trees, rate in zip(*told.value, rates):
            p = values[at]
            if new.any():
                p[new] = sum((1.0 if i == 0 else rate) * tree["value"][walk(tree, bins)] for i, tree in enumerate(grown_trees))
            out.append(p[place])
        return out

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            p = scores(np.concatenate([_places(_matrix(b.column(0), d, False), edges) for b in held]))
            done = 0
            for b in held:
                mine = [pa.array(x[done : done + b.num_rows]) for x in p]
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *mine], names=[*b.schema.names[1:], *[f"_p_{n}" for n in names]])
            held.clear()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) * d > 1_000_000:
                yield from settle()
        if held:
            yield from settle()

    def transform(rows: DataFrame) -> DataFrame:
        others = rows.drop("features")
        schema = StructType([*others.schema.fields, *[StructField(f"_p_{n}", DoubleType()) for n in names]])
        return rows.select(vector_to_array("features").alias("_x"), *others.columns).mapInArrow(predicted, schema)

    return transform


def _out_of_fold(states: DataFrame, shared, names: list[str], folds: tuple[int, ...]) -> DataFrame:
    """A row for each cell of each fold: its mean label, its rows as ``weight``, and what each variant's
    model of the other folds says."""

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, told = shared.value, {}
        for batch in batches:
            for fold, name, state in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                told.setdefault(fold, {})[name] = np.frombuffer(state, np.float64)
        for fold, by in told.items():
            n, s = cells.n[fold], cells.s[fold]
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(s[has] / n[has]), pa.array(n[has]), *[pa.array(by[x][has]) for x in names]], names=["label", "weight", *[f"_p_{x}" for x in names]])

    schema = "label double, weight double, " + ", ".join(f"`_p_{x}` double" for x in names)
    return states.where("fold >= 0").repartitionById(len(folds), F.col("fold")).mapInArrow(shown, schema)


@dataclass(frozen=True)
class Fitted:
    """``models``; ``held``: weighted cells with their mean label and what models fitted on all folds but
    one predict for that one (None without folds); ``predict`` adds ``_p_<model>`` to rows."""

    models: dict[str, GBTRegressionModel]
    held: DataFrame | None
    predict: Callable[[DataFrame], DataFrame]


def fit_on_cells(train: DataFrame, spec: SeriesSpec, estimators: dict[str, GBTRegressor], folds: int) -> Fitted | None:
    """Every estimator fitted on ``train`` (keys, features, label; the ``fold``, if it is known), and on all
    folds but one. None if there are too many cells."""
    first = train.select("features").first()
    if first is None:
        raise ValueError("no rows to learn from")
    spark, d, kinds = train.sparkSession, first["features"].size, list(estimators.values())
    most = {e.getMaxBins() for e in kinds}
    plain = all(e.getLossType() == "squared" and e.getMinInstancesPerNode() == 1 and e.getMinInfoGain() == 0 for e in kinds)
    if d == 0 or len(most) != 1 or max(most) > 250 or not plain:
        return None
    edges, total = _edges(train, d, most.pop())
    widths, parts = tuple(len(e) + 1 for e in edges), max(folds, 1)
    each = d + 16 * parts
    x = vector_to_array("features").alias("x")
    if prod(widths) * each > MOST_BYTES:
        seen = _binned(train.select(F.lit(0).alias("fold"), x, "label", F.lit(0).cast("bigint").alias("h")), edges)
        if seen.agg(F.approx_count_distinct("_cell", 0.02)).first()[0] * each > MOST_BYTES:
            return None
    rows = with_folds(train, spec, folds) if folds else train.withColumn("fold", F.lit(0))
    rows = _binned(rows.select("fold", x, "label", F.xxhash64(*[F.col(k) for k in spec.keys]).alias("h")), edges)
    tasks = 1 + total // ROWS_PER_TASK
    # a cell is drawn from in one task, unless there are fewer cells than tasks
    by = ["_cell"] if prod(widths) >= 8 * tasks else ["_cell", F.pmod("h", F.lit(tasks))]
    rows = staged(_packed(rows.repartition(tasks, *by).sortWithinPartitions("_cell", "fold"), d), "binned")
    counts = staged(_counts(rows, d), "counts")
    if counts.select("_cell").distinct().count() * each > MOST_BYTES:
        dropped(rows)
        return None
    shared = spark.sparkContext.broadcast(_table(counts, widths, parts))
    asked = (-1, *range(folds))
    variants = {name: _variant(e, d) for name, e in estimators.items()}
    # variants that draw go first: they take turns of drawing and growing, the others one long task a model
    order = sorted(variants, key=lambda name: variants[name].rows)
    with ThreadPoolExecutor(max_workers=len(order)) as pool:
        fit = inheritable_thread_target(spark)(lambda name: _fit(rows, shared, variants[name], asked))
        grown = dict(zip(order, pool.map(fit, order)))
        build = inheritable_thread_target(spark)(lambda name: _model(spark, estimators[name], grown[name], edges, variants[name]))
        models = dict(zip(estimators, pool.map(build, estimators)))
    dropped(rows)
    predict, held = _predictor(shared, edges, variants, grown), None
    if folds:
        last = [grown[n][-1].where("state IS NOT NULL").select((F.col("model") - 1).alias("fold"), F.lit(n).alias("name"), "state") for n in estimators]
        held = staged(_out_of_fold(reduce(DataFrame.unionByName, last), shared, list(estimators), asked[1:]), "held")
    return Fitted(models, held, predict)


def _variant(e: GBTRegressor, d: int) -> Variant:
    subset = e.getFeatureSubsetStrategy()
    columns = d if subset in ("all", "auto") else ceil(float(subset) * d)
    return Variant(e.getMaxIter(), e.getMaxDepth(), e.getStepSize(), e.getSubsamplingRate(), columns, e.getSeed())
