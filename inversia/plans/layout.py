"""Cut hot series into chunks so that no task ever holds a whole hot site.

Most series operators are window functions over ``partitionBy(site).orderBy(ts)``. That is one
shuffle and the right plan as long as no site outgrows a task. ``plan_layout`` checks that with
one aggregate over the key columns. Sites that are too long are cut along time:

* a histogram of the hot sites (map-side combined) splits each into cells of equal time width,
  and splits again those cells that are still too full, so bursts are followed;
* neighbouring cells are packed into chunks of about ``rows`` rows, and since every cell's count
  is known, so is the exact position of each chunk's first row in its series;
* ``spread`` sends every row to its chunk, plus to the neighbours that need it as lookback or
  lookahead, so window frames see exactly the rows they would see in the uncut series.

Whole-series state (running sums, last known value) is computed per chunk and the chunk totals
are scanned in a second, tiny window (``running``, ``carry``).

The cut plan is bounded: a chunk has at least ``total / MAX_CHUNKS`` rows, so there are at most
MAX_CHUNKS hot sites and about CELLS_PER_CHUNK * MAX_CHUNKS cells, whatever the table's size. It
is therefore safe to build on the driver and to broadcast. Rows of equal time are cut by the
tie-break columns; only rows equal in every order column stay together. Rows whose order value is
null sort first and have a cell of their own before the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inversia.plans.series import MAX_CHUNKS, SeriesSpec, order_numbers

CHUNK, OWN, FIRST, TOTAL = "_chunk", "_own", "_first", "_total"
CELLS_PER_CHUNK = 8
# (site key values and cell path so far) -> (order column, low, low as a whole number, width) of its sub-cells
Level = dict[tuple, tuple[int, float, int | None, float]]
HELPERS = (CHUNK, OWN, FIRST, TOTAL)


@dataclass
class Cell:
    """A time range of one hot site: its path in the nested histogram and its rows."""

    path: tuple[int, ...]
    rows: int


@dataclass
class SeriesLayout:
    """How the series of a table are spread over tasks; see the module text."""

    spec: SeriesSpec
    levels: list[Level] = field(default_factory=list)
    cells: dict[tuple, list[Cell]] = field(default_factory=dict)
    rows: int = 0

    @property
    def cut(self) -> bool:
        return bool(self.cells)

    # -- windows ---------------------------------------------------------------------------
    @property
    def window(self) -> WindowSpec:
        """Ordered window of a spread table."""
        return self.spec.window(*((CHUNK,) if self.cut else ()))

    @property
    def upto(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # -- placement -------------------------------------------------------------------------
    def spread(self, df: DataFrame, lookback: int = 0, lookahead: int = 0) -> DataFrame:
        """Rows with their chunk; rows needed next door appear there with ``_own`` false."""
        if not self.cut:
            return df
        spec, site = self.spec, self.spec.site
        located = _locate(df, spec, self.levels)
        depth = len(self.levels)
        schema = T.StructType(
            [T.StructField(f"_s{i}", df.schema[c].dataType) for i, c in enumerate(site)]
            + [T.StructField(f"_c{d}", T.LongType()) for d in range(depth)]
            + [
                T.StructField(
                    "_targets",
                    T.ArrayType(
                        T.StructType(
                            [
                                T.StructField(CHUNK, T.IntegerType()),
                                T.StructField(OWN, T.BooleanType()),
                                T.StructField(FIRST, T.LongType()),
                                T.StructField(TOTAL, T.LongType()),
                            ]
                        )
                    ),
                )
            ]
        )
        plan = []
        for key, cells in self.cells.items():
            for cell, targets in zip(cells, self._targets(cells, lookback, lookahead)):
                path = list(cell.path) + [0] * (depth - len(cell.path))
                plan.append((*key, *path, targets))
        plan_df = F.broadcast(df.sparkSession.createDataFrame(plan, schema))
        on = reduce(
            Column.__and__,
            [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(site)]
            + [F.col(f"_p{d}") == F.col(f"_c{d}") for d in range(depth)],
        )
        whole = F.array(
            F.struct(
                F.lit(0).alias(CHUNK),
                F.lit(True).alias(OWN),
                F.lit(0).cast("bigint").alias(FIRST),
                F.lit(None).cast("bigint").alias(TOTAL),
            )
        )
        joined = located.join(plan_df, on, "left")
        return joined.select(
            *df.columns, F.inline(F.coalesce(F.col("_targets"), whole)).alias(*HELPERS)
        )

    def _starts(self, cells: Sequence[Cell]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row range of every cell, and the chunk it belongs to."""
        counts = np.array([c.rows for c in cells], dtype=np.int64)
        end = np.cumsum(counts)
        begin = end - counts
        raw = begin // self.rows
        chunk = np.concatenate([[0], np.cumsum(np.diff(raw) > 0)]).astype(np.int64)
        return begin, end, chunk

    def _targets(self, cells: Sequence[Cell], lookback: int, lookahead: int) -> list[list[tuple]]:
        begin, end, chunk = self._starts(cells)
        n = int(chunk[-1]) + 1
        first_cell = np.searchsorted(chunk, np.arange(n), side="left")
        last_cell = np.searchsorted(chunk, np.arange(n), side="right") - 1
        start, stop = begin[first_cell], end[last_cell]
        # earliest cell each chunk takes over as lookback fixes its first position
        need_from = np.searchsorted(end, start - lookback, side="right") if lookback else first_cell
        need_from = np.minimum(need_from, first_cell)
        need_to = np.searchsorted(begin, stop + lookahead, side="left") - 1 if lookahead else last_cell
        need_to = np.maximum(need_to, last_cell)
        out: list[list[tuple]] = [[] for _ in cells]
        for c in range(n):
            for i in range(int(need_from[c]), int(need_to[c]) + 1):
                out[i].append((c, bool(chunk[i] == c), int(begin[need_from[c]]), int(end[-1])))
        return out

    # -- exact whole-series quantities -----------------------------------------------------
    def own(self, df: DataFrame) -> DataFrame:
        """Drop the neighbours' rows and the helper columns."""
        return df.where(OWN).drop(*HELPERS) if self.cut else df

    def position(self) -> Column:
        """0-based position of the row in its whole series (needs a spread table)."""
        local = F.row_number().over(self.window).cast("bigint") - 1
        return F.col(FIRST) + local if self.cut else local

    def length(self) -> Column:
        """Rows in the whole series; a cut series' length comes from the cut plan."""
        local = F.count(F.lit(1)).over(Window.partitionBy(*self.spec.site, *((CHUNK,) if self.cut else ())))
        return F.coalesce(F.col(TOTAL), local) if self.cut else local

    def running(self, df: DataFrame, **sums: Column) -> DataFrame:
        """Add exact running sums (current row included) over each whole series."""
        local = {n: F.sum(F.when(F.col(OWN), e) if self.cut else e).over(self.upto) for n, e in sums.items()}
        if not self.cut:
            return df.select("*", *[F.coalesce(e, F.lit(0)).alias(n) for n, e in local.items()])
        site = list(self.spec.site)
        totals = df.where(OWN).groupBy(*site, CHUNK).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
        before = Window.partitionBy(*site).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        base = self._cut_only(totals).select(
            *[F.col(c).alias(f"_b_{c}") for c in site],
            F.col(CHUNK).alias("_b_chunk"),
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums],
        )
        joined = df.select("*", *[F.coalesce(e, F.lit(0)).alias(f"_l_{n}") for n, e in local.items()]).join(
            F.broadcast(base), self._on_chunk(site), "left"
        )
        return joined.select(
            *df.columns,
            *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_t_{n}"), F.lit(0))).alias(n) for n in sums],
        )

    def carry(self, df: DataFrame, columns: Sequence[str], position: str | None = None) -> DataFrame:
        """Add ``_prev_<c>`` and ``_next_<c>``: the nearest known value at or before / at or after
        the row in its whole series. With ``position`` also its position, ``_prev_at_<c>`` etc."""

        def item(c: str) -> Column:
            at = F.col(position) if position else F.lit(None).cast("bigint")
            known = F.col(c).isNotNull() & (F.col(OWN) if self.cut else F.lit(True))
            return F.when(known, F.struct(F.col(c).alias("v"), at.alias("at")))

        # looking ahead is looking back in reversed order: a frame that runs to the end of the
        # series from every row would be evaluated anew for each row
        later_first = [F.desc(c) for c in ((position,) if position else self.spec.order)]
        down = (
            Window.partitionBy(*self.spec.site, *((CHUNK,) if self.cut else ()))
            .orderBy(*later_first)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        held = df.select(
            "*",
            *[F.last(item(c), ignorenulls=True).over(self.upto).alias(f"_lp_{c}") for c in columns],
            *[F.last(item(c), ignorenulls=True).over(down).alias(f"_ln_{c}") for c in columns],
        )
        if self.cut:
            site = list(self.spec.site)
            # the first and last known item of each chunk, then the nearest one before / after it
            order = F.struct(*[F.col(c) for c in self.spec.order])
            edges = df.where(OWN).groupBy(*site, CHUNK).agg(
                *[F.max_by(item(c), F.when(F.col(c).isNotNull(), order)).alias(f"_e_{c}") for c in columns],
                *[F.min_by(item(c), F.when(F.col(c).isNotNull(), order)).alias(f"_f_{c}") for c in columns],
            )
            by_chunk = Window.partitionBy(*site)
            before = by_chunk.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
            after = by_chunk.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
            base = self._cut_only(edges).select(
                *[F.col(c).alias(f"_b_{c}") for c in site],
                F.col(CHUNK).alias("_b_chunk"),
                *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_e_{c}") for c in columns],
                *[F.last(f"_f_{c}", ignorenulls=True).over(after).alias(f"_f_{c}") for c in columns],
            )
            held = held.join(F.broadcast(base), self._on_chunk(site), "left")
            prev = {c: F.coalesce(F.col(f"_lp_{c}"), F.col(f"_e_{c}")) for c in columns}
            nxt = {c: F.coalesce(F.col(f"_ln_{c}"), F.col(f"_f_{c}")) for c in columns}
        else:
            prev = {c: F.col(f"_lp_{c}") for c in columns}
            nxt = {c: F.col(f"_ln_{c}") for c in columns}
        wanted = [x for c in columns for x in (prev[c]["v"].alias(f"_prev_{c}"), nxt[c]["v"].alias(f"_next_{c}"))]
        if position:
            wanted += [
                x for c in columns for x in (prev[c]["at"].alias(f"_prev_at_{c}"), nxt[c]["at"].alias(f"_next_at_{c}"))
            ]
        return held.select(*df.columns, *wanted)

    def _cut_only(self, per_chunk: DataFrame) -> DataFrame:
        """Only cut sites have more than one chunk; the others need no base. At most one row per
        chunk of a cut site is left, which the module text bounds."""
        site = list(self.spec.site)
        keys = self._keys_df(per_chunk)
        on = reduce(
            Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(site)], F.lit(True)
        )
        return per_chunk.join(F.broadcast(keys), on, "left_semi")

    def _keys_df(self, like: DataFrame) -> DataFrame:
        schema = T.StructType(
            [T.StructField(f"_k{i}", like.schema[c].dataType) for i, c in enumerate(self.spec.site)]
            + [T.StructField("_k", T.IntegerType())]
        )
        return like.sparkSession.createDataFrame([(*k, 0) for k in self.cells], schema)

    @staticmethod
    def _on_chunk(site: Sequence[str]) -> Column:
        return reduce(
            Column.__and__,
            [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in site],
            F.col(CHUNK) == F.col("_b_chunk"),
        )


def _locate(df: DataFrame, spec: SeriesSpec, levels: list[Level]) -> DataFrame:
    """Add the cell path ``_p0, _p1, ...`` of every row (null for sites that are not cut)."""
    spark = df.sparkSession
    numbers = order_numbers(df, spec)
    depth_of = max((g[0] for level in levels for g in level.values()), default=0) + 1
    added = [f"_o{i}" for i in range(depth_of)]
    out = df.select("*", *[n.alias(a) for n, a in zip(numbers, added)])
    whole = {f.name for f in out.schema.fields if f.name in added and isinstance(f.dataType, T.IntegralType)}
    for depth, level in enumerate(levels):
        schema = T.StructType(
            [T.StructField(f"_s{i}", df.schema[c].dataType) for i, c in enumerate(spec.site)]
            + [T.StructField(f"_c{d}", T.LongType()) for d in range(depth)]
            + [T.StructField("_k", T.IntegerType()), T.StructField("_low", T.DoubleType())]
            + [T.StructField("_whole", T.LongType()), T.StructField("_width", T.DoubleType())]
        )
        on = reduce(
            Column.__and__,
            [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(spec.site)]
            + [F.col(f"_p{d}") == F.col(f"_c{d}") for d in range(depth)],
            F.lit(True),
        )
        along = F.lit(None).cast("double")
        for i, a in enumerate(added):
            here = F.col(a) - F.col("_low")
            if a in whole:  # exactly, however large the numbers
                here = F.when(F.col("_whole").isNotNull(), (F.col(a) - F.col("_whole")).cast("double")).otherwise(here)
            along = F.when(F.col("_k") == i, here).otherwise(along)
        # a null order value sorts before all others
        step = F.when(F.col("_k").isNotNull(), F.coalesce(F.floor(along / F.col("_width")), F.lit(-1).cast("bigint")))
        if depth:  # rows of cells that were small enough already stay in sub-cell 0
            step = F.coalesce(step, F.when(F.col("_p0").isNotNull(), F.lit(0).cast("bigint")))
        grids = F.broadcast(spark.createDataFrame([(*key, *grid) for key, grid in level.items()], schema))
        helpers = [*[f"_s{i}" for i in range(len(spec.site))], *[f"_c{d}" for d in range(depth)], "_k", "_low", "_whole", "_width"]
        out = out.join(grids, on, "left").withColumn(f"_p{depth}", step).drop(*helpers)
    return out.drop(*added)


def settled(df: DataFrame, spec: SeriesSpec) -> SeriesSpec:
    """The spec with the table's layout attached, so that several operators share one check.
    Valid for tables with the same rows (other columns may differ)."""
    return spec.but(layout=plan_layout(df, spec))


def plan_layout(df: DataFrame, spec: SeriesSpec) -> SeriesLayout:
    """Check the length of every series (one aggregate over the key columns) and plan the cuts."""
    if spec.layout is not None:
        return spec.layout
    site = list(spec.site)
    numbers = order_numbers(df, spec)
    order = [f"_extent{i}" for i in range(len(numbers))]

    def measured(levels: list[Level], known: int) -> DataFrame:
        """Rows and extents of the first ``known`` order columns, per site or per cell of the last level."""
        keyed = df.select(*spec.keys, *[n.alias(o) for n, o in zip(numbers[:known], order)])
        path = [f"_p{d}" for d in range(len(levels))]
        if levels:
            keyed = _locate(keyed, spec, levels).where(F.col(path[-1]).isNotNull())
        extent = [x for o in order[:known] for x in (F.min(o).alias(f"_l{o}"), F.max(o).alias(f"_h{o}"), F.count(o).alias(f"_c{o}"))]
        return keyed.groupBy(*site, *path).agg(F.count(F.lit(1)).alias("_n"), *extent)

    known = 1  # tie-breaks are looked at only where equal times call for them
    # one row per site, kept so that the table itself is read once for both questions
    sizes = measured([], known).persist()
    try:
        total, longest = sizes.agg(F.sum("_n"), F.max("_n")).first()
        layout = SeriesLayout(spec, rows=max(spec.rows_per_chunk, (total or 0) // MAX_CHUNKS))
        if not total or longest <= layout.rows:
            return layout
        # fewer than MAX_CHUNKS sites can pass this filter
        hot = sizes.where(F.col("_n") > layout.rows).collect()
    finally:
        sizes.unpersist()

    def grid(row) -> tuple[int, float, int | None, float] | None:
        """Equal cells along the first known order column in which the rows differ."""
        for k, o in enumerate(order[:known]):
            low, high, some = row[f"_l{o}"], row[f"_h{o}"], row[f"_c{o}"]
            if low is None:
                continue
            if high > low or some < row["_n"]:  # rows with and without a value differ too
                cells = max(2, -(-row["_n"] * CELLS_PER_CHUNK // layout.rows))
                exact = low if isinstance(low, int) and high - low < 2**63 else None
                return k, float(low), exact, max(float(high - low) / cells, float(np.finfo(float).tiny))
        return None

    if known < len(order) and any(grid(row) is None for row in hot):
        known = len(order)
        hot = measured([], known).where(F.col("_n") > layout.rows).collect()
    level: Level = {tuple(row[c] for c in site): grid(row) for row in hot}
    level = {key: g for key, g in level.items() if g}
    before = {tuple(row[c] for c in site): row["_n"] for row in hot}
    done: dict[tuple, dict[tuple[int, ...], int]] = {}
    while level:  # until every cell is small enough or holds equal rows only
        layout.levels.append(level)
        path = [f"_p{d}" for d in range(len(layout.levels))]
        counted = measured(layout.levels, known).collect()
        if known < len(order) and any(row["_n"] > layout.rows and grid(row) is None for row in counted):
            known = len(order)
            counted = measured(layout.levels, known).collect()
        parents, before, done, level = before, {}, {}, {}
        for row in counted:
            key, cell = tuple(row[c] for c in site), tuple(row[p] for p in path)
            done.setdefault(key, {})[cell] = row["_n"]
            # a cell that took all of its parent holds values that doubles can't tell apart
            if layout.rows < row["_n"] < parents.get((*key, *cell[:-1]), 0):
                finer = grid(row)
                if finer:
                    level[(*key, *cell)] = finer
                    before[(*key, *cell)] = row["_n"]
    layout.cells = {key: [Cell(p, n) for p, n in sorted(found.items())] for key, found in done.items()}
    return layout
