"""Boosted trees of many small groups, each fitted whole where its rows are.

The trees are those of ``grouped_trees``: the same edges, draws, gains and leaves. A group of few cells
needs no aggregates of Spark's: its rows are brought into one task once, which grows all variants of
all folds there. Groups of a task are grown together, some rows at a time, in arrays. So a row is
shuffled once and written once, whatever the folds, variants, rounds and depth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from inversia.operators.grouped_trees import Growth

#: Groups are grown together until they have so many rows.
ROWS_AT_ONCE = 200_000
P1, P2, P3, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_on(h: np.ndarray, number: int) -> np.ndarray:
    """``xxhash64(..., number)`` of an int, from the hash of what is before it."""
    with np.errstate(over="ignore"):
        z = h.astype(np.int64).view(np.uint64) + P5 + np.uint64(4)
        z ^= np.uint64(number & 0xFFFFFFFF) * P1
        z = ((z << np.uint64(23)) | (z >> np.uint64(41))) * P2 + P3
        z = (z ^ (z >> np.uint64(33))) * P2
        z = (z ^ (z >> np.uint64(29))) * P3
        return (z ^ (z >> np.uint64(32))).view(np.int64)


def _drawn(h: np.ndarray, numbers: Sequence[int], share: float) -> np.ndarray:
    for number in numbers:
        h = hash_on(h, number)
    return h % 1000 < int(share * 1000)


def _cells(v: np.ndarray, bits: int) -> np.ndarray:
    """Values cut to their leading bits, as ``grouped_trees.bin_edges`` does."""
    size = np.abs(v)
    plain = (size >= 1e-290) & (size <= 1e290)
    if bits >= 52 or not plain.any():
        return v
    scale = np.exp2(bits - np.floor(np.log2(np.where(plain, size, 1.0))))
    return np.where(plain, np.floor(np.where(plain, v, 1.0) * scale) / scale, v)


class Feature:
    """A column of some groups' rows, sorted once for all folds."""

    def __init__(self, v: np.ndarray, gid: np.ndarray, bits: int):
        known = ~np.isnan(v)
        values, rank = np.unique(np.where(known, v, 0.0), return_inverse=True)
        self.many, self.known, self.gid = len(values), known, gid
        self.key = gid * self.many + rank
        self.cell = _cells(v, bits)
        order = np.argsort(self.key, kind="stable")
        self.order = order[known[order]]

    def bins(self, learn: np.ndarray, asked: np.ndarray, groups: int, most: int) -> np.ndarray:
        """Bins of the rows that are ``asked`` for, edges from those that are learned from; 0 for unknown."""
        o = self.order[learn[self.order]]
        edges = np.empty(0, np.int64)
        if len(o):
            g, c = self.gid[o], self.cell[o]
            start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            n, of = np.diff(np.r_[start, len(o)]), g[start]
            total, many = np.bincount(of, n, groups), np.bincount(of, minlength=groups)
            upto = np.cumsum(n) - np.r_[0.0, np.cumsum(total)][of]
            steps = [np.floor(x * most / total[of]) for x in (upto, upto - n)]
            chosen = ((many[of] <= most) | (steps[0] > steps[1])) & (upto < total[of])
            edges = self.key[o[(start + n - 1)[chosen]]]
        before = np.searchsorted(edges, np.arange(groups) * self.many)
        place = np.searchsorted(edges, self.key[asked]) - before[self.gid[asked]] + 1
        return np.where(self.known[asked], place, 0)


def _entries(key: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, with the sum of ``g`` and the count of each."""
    if size <= 4 * len(key) + 1024:
        n = np.bincount(key, minlength=size)
        kept = np.flatnonzero(n)
        return kept, np.bincount(key, g, size)[kept], n[kept].astype(np.float64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(g[order], start), np.diff(np.r_[start, len(key)]).astype(np.float64)


def _part(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return g * g / (h + l2)  # not a number where nothing is on a side: no cut then


def grow(bins: list[np.ndarray], gid: np.ndarray, g: np.ndarray, seen: np.ndarray, allowed: np.ndarray, growth: Growth, gains: np.ndarray) -> np.ndarray:
    """A tree for each group: what it adds to every row. ``g`` are gradients, ``seen`` the rows to learn
    from, ``allowed`` which features a group may cut; ``gains`` of groups and features are added to."""
    group = np.arange(len(allowed))
    slot, step = gid.copy(), np.zeros(len(gid))
    widths = [int(b.max(initial=0)) + 1 for b in bins]
    for level in range(growth.depth + 1):
        size, mine = len(group), seen & (slot >= 0)
        at, gm = slot[mine], g[mine]
        ga, ha = np.bincount(at, gm, size), np.bincount(at, minlength=size).astype(np.float64)
        feature, cut, gain = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        best = np.full(size, max(growth.least_gain, 0.0), np.float32)
        for f in range(len(bins) if level < growth.depth and len(at) else 0):
            key, gs, hs = _entries(at * widths[f] + bins[f][mine], gm, size * widths[f])
            node, bin_ = np.divmod(key, widths[f])
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            many = np.diff(np.r_[start, len(node)])
            gl, hl = ((c := np.cumsum(x)) - np.repeat(c[start] - x[start], many) for x in (gs, hs))
            gt, ht = ga[node], ha[node]
            value = _part(gl, hl, growth.l2) + _part(gt - gl, ht - hl, growth.l2) - _part(gt, ht, growth.l2)
            may = (hl >= growth.least) & (ht - hl >= growth.least) & (value > max(growth.least_gain, 0.0)) & allowed[group[node], f]
            about = np.where(may, value, -np.inf).astype(np.float32)
            top = np.maximum.reduceat(about, start)
            first = np.minimum.reduceat(np.where(about == np.repeat(top, many), np.arange(len(node)), len(node)), start)
            better = top > best[node[start]]
            which, first = node[start][better], first[better]
            best[which], feature[which], cut[which], gain[which] = top[better], f, bin_[first], value[first]
        split = feature >= 0
        leaf = np.divide(-ga, ha + growth.l2, out=np.zeros(size), where=ha + growth.l2 > 0) * growth.rate
        inside = slot >= 0
        ends = inside.copy()
        ends[inside] = ~split[slot[inside]]
        step[ends] = leaf[slot[ends]]
        if not split.any():
            break
        np.add.at(gains, (group[split], feature[split]), gain[split])
        rows = np.flatnonzero(inside & ~ends)
        on = slot[rows]
        right = np.zeros(len(rows), bool)
        for f in np.unique(feature[split]):
            those = feature[on] == f
            right[those] = bins[f][rows[those]] > cut[on[those]]
        slot[ends] = -1
        slot[rows] = 2 * (np.cumsum(split) - 1)[on] + right
        group = np.repeat(group[split], 2)
    return step


def fit_groups(
    gid: np.ndarray, x: list[np.ndarray], y: np.ndarray, train: np.ndarray, fold: np.ndarray, row_hash: np.ndarray, group_hash: np.ndarray, folds: Sequence[int], growths: Sequence[Growth]
) -> tuple[np.ndarray, np.ndarray]:
    """Predictions, a row a variant: of test rows by the models of all training rows, of a training row
    by those that did not see its fold; NaN where there is none. And each variant's share of gains by
    group and feature. ``folds``: -1 for the models of all training rows, then the folds."""
    groups, d = len(group_hash), len(x)
    filled = []
    for v in x:
        fine = np.isfinite(v)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.bincount(gid, np.where(fine & train, v, 0.0), groups) / np.bincount(gid, fine & train, groups)
        filled.append(np.where(fine, v, mean[gid]))
    features = [Feature(v, gid, growths[0].bits) for v in filled]
    out, shares = np.full((len(growths), len(y)), np.nan), np.zeros((len(growths), groups, d))
    for k in folds:
        out_of = ~train if k < 0 else train & (fold == k)
        learn = train & ~out_of & ~np.isnan(y)
        rows = np.flatnonzero(learn | out_of)
        bins = [f.bins(learn, rows, groups, growths[0].bins) for f in features]
        mine, known, label = gid[rows], learn[rows], y[rows]
        count = np.bincount(mine, known, groups)
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.bincount(mine, np.where(known, label, 0.0), groups) / count
        told = np.flatnonzero(out_of[rows])
        of_fold = hash_on(group_hash, k)
        for i, growth in enumerate(growths):
            p, gains = base[mine], np.zeros((groups, d))
            for tree in range(growth.rounds):
                seen = known if growth.rows >= 1 else known & _drawn(row_hash[rows], (tree, growth.seed), growth.rows)
                allowed = np.ones((groups, d), bool)
                if growth.columns < 1:
                    allowed = np.stack([_drawn(of_fold, (tree, f, growth.seed), growth.columns) for f in range(d)], 1)
                p = p + grow(bins, mine, np.where(seen, p - label, 0.0), seen, allowed, growth, gains)
            out[i, rows[told]] = p[told]
            if k < 0:
                whole = gains.sum(1, keepdims=True)
                shares[i] = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0)
    return out, shares


def fit_folds(rows: DataFrame, group: Sequence[str], order: Sequence[str], features: Sequence[str], keys: Sequence[str], folds: Sequence[int], growths: dict[str, Growth]) -> DataFrame:
    """``rows`` (``group``, ``order``, ``features``, ``label``, ``is_train``, ``fold``), whose groups lie whole and
    together in a partition, to the same without ``features`` and with a prediction by each variant's
    name; and a row a group with ``shares``: the importance of every feature, variant by variant.

    Null, NaN and infinite features take the mean of their group's training rows."""
    sizes, columns = list(growths.values()), [*group, *order, "label", "is_train", "fold"]
    if {g.loss for g in sizes} != {"squared"} or len({(g.bins, g.bits) for g in sizes}) != 1:
        raise ValueError("variants differ in bins or bits, or their loss isn't squared")
    hashes = [F.xxhash64(*[F.col(k) for k in by]).alias(n) for n, by in (("_row", keys), ("_group", group))]
    wide = rows.select(*columns, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], *hashes)
    kinds = [rows.schema[c] for c in (*group, *order)]
    schema = StructType(
        [StructField(f.name, f.dataType) for f in kinds]
        + [StructField("label", DoubleType()), StructField("is_train", BooleanType()), StructField("fold", IntegerType())]
        + [StructField(n, DoubleType()) for n in growths]
        + [StructField("shares", ArrayType(DoubleType()))]
    )
    width, d = len(group), len(features)

    def starts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows, bool)
        changed[:1] = True
        for c in group:
            code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            changed[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(changed)

    def fitted(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        gid = np.repeat(np.arange(len(start)), np.diff(np.r_[start, table.num_rows]))
        plain = {c: table.column(c).to_numpy() for c in ("label", "_row", "_group", *[f"_x{i}" for i in range(d)])}
        train = table.column("is_train").to_numpy().astype(bool)
        fold = table.column("fold").fill_null(-1).to_numpy()
        found, shares = fit_groups(gid, [plain[f"_x{i}"].astype(np.float64) for i in range(d)], plain["label"], train, fold, plain["_row"], plain["_group"][start], folds, sizes)
        made = [pa.array(p, from_pandas=True) for p in found]  # not a number: null
        told = table.select(columns).columns + made + [pa.nulls(table.num_rows, pa.list_(pa.float64()))]
        yield from pa.Table.from_arrays(told, names=schema.names).to_batches()
        learned = start[np.bincount(gid, train, len(start)) > 0]
        first = table.take(pa.array(learned))
        by_group = shares[:, gid[learned]].transpose(1, 0, 2).reshape(len(learned), -1)
        lists = pa.array(list(by_group), pa.list_(pa.float64()))
        empty = [pa.nulls(len(learned), f.type) for f in (table.schema.field(c) for c in columns[width:])]
        yield from pa.Table.from_arrays([*first.select(list(group)).columns, *empty, *[pa.nulls(len(learned), pa.float64())] * len(found), lists], names=schema.names).to_batches()

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                table = pa.Table.from_batches(held)
                start = starts(table)
                if len(start) > 1:  # the last group may go on
                    yield from fitted(table.slice(0, start[-1]), start[:-1])
                    table = table.slice(start[-1])
                held = table.to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from fitted(table, starts(table))

    return wide.mapInArrow(grown, schema)
