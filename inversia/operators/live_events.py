"""Inversion events of rows that keep arriving, without going over the old ones again.

What is carried from one arrival to the next is small: rows younger than the allowed lateness, which
may still be joined by late ones; for each site its open event, as the sums that describe it; and the
time up to which rows are settled. An arrival settles what has come of age, continues open events,
closes those that end, and never reads settled rows again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inversia.functions.calendar import season_name
from inversia.plans.joins import match
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec, micros
from inversia.session import staged

SUMS = ("start_time", "end_time", "n_steps", "first_us", "last_us", "max_strength", "sum_strength")


@dataclass(frozen=True)
class LiveState:
    """``tail``: keys, ``_us`` and ``_strength`` of rows not settled; ``open``: site and sums of its
    open event; ``settled``: rows up to this time (microseconds) are settled, None before any."""

    tail: DataFrame
    open: DataFrame
    settled: int | None = None


def _plain(df: DataFrame, spec: SeriesSpec, strength: Column) -> DataFrame:
    return df.where(F.col(spec.ts).isNotNull()).select(*spec.keys, micros(df, spec.ts).alias("_us"), strength.cast("double").alias("_strength"))


def _runs(rows: DataFrame, spec: SeriesSpec, threshold: float) -> DataFrame:
    """Sums of every run above the threshold, and whether it is at the first or last of the rows."""
    layout = plan_layout(rows, spec)
    above = F.coalesce(F.col("_strength") > threshold, F.lit(False))
    placed = layout.spread(rows).withColumns({"_at": layout.position(), "_of": layout.length()})
    placed = layout.own(layout.running(placed, _event=F.when(above, 0).otherwise(1)))
    return placed.where(above).groupBy(*spec.site, "_event").agg(
        F.min(spec.ts).alias("start_time"), F.max(spec.ts).alias("end_time"), F.count("*").alias("n_steps"), F.min("_us").alias("first_us"), F.max("_us").alias("last_us"),
        F.max("_strength").alias("max_strength"), F.sum("_strength").alias("sum_strength"), (F.min("_at") == 0).alias("_first"), (F.max("_at") == F.max("_of") - 1).alias("_last"),
    ).drop("_event")


def _described(events: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The columns of ``windows.inversion_events``."""
    return events.select(
        *spec.site, "start_time", "end_time", "n_steps", ((F.col("last_us") - F.col("first_us")) / F.lit(3.6e9)).alias("elapsed_hours"), F.col("max_strength").alias("max_inversion_strength"),
        (F.col("sum_strength") / F.col("n_steps")).alias("avg_inversion_strength"), season_name(F.month("start_time")).alias("season"),
    )


def _joined(a: str, b: str) -> list[Column]:
    """The sums of two stretches of one event; either may be absent (nulls)."""
    least, most = ("start_time", "first_us"), ("end_time", "last_us", "max_strength")
    out = []
    for c in SUMS:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        both = F.least(x, y) if c in least else F.greatest(x, y) if c in most else F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        out.append(both.alias(c))
    return out


def start(df: DataFrame, spec: SeriesSpec, strength: Column) -> LiveState:
    """The state before any row, for tables like ``df`` (its rows are not read)."""
    tail = _plain(df.limit(0), spec, strength)
    return LiveState(tail, _runs(tail, spec, 0.0).drop("_first", "_last"))


def advance(
    state: LiveState, arrived: DataFrame, spec: SeriesSpec, strength: Column, threshold: float = 0.0, lateness_s: float = 0.0, last: bool = False
) -> tuple[DataFrame, DataFrame, LiveState]:
    """Take rows that arrived: events that are now closed, rows that came too late, the next state.

    Rows are settled when a row ``lateness_s`` younger has come from any site (0: when any younger or
    equally old one has; then the rows of an arrival must all be younger than those before). Within
    that time rows may come in any order. A row that is not younger than what is settled is too late: it
    is returned and changes nothing. Rows without a time are left out. ``last``: settle and close all.
    Fed with all rows in arrivals, the events are those of one pass over all rows."""
    rows = staged(_plain(arrived, spec, strength), "arrived")
    late = rows.where(F.col("_us") <= state.settled) if state.settled is not None else rows.limit(0)
    fresh = rows.where(F.col("_us") > state.settled) if state.settled is not None else rows
    waiting = staged(state.tail.unionByName(fresh), "waiting")
    newest = waiting.agg(F.max("_us")).first()[0]
    if newest is None:
        bound = state.settled
    else:
        bound = newest if last else max(newest - int(lateness_s * 1_000_000), state.settled if state.settled is not None else newest - int(lateness_s * 1_000_000))
    ripe = waiting.where(F.col("_us") <= bound) if bound is not None else waiting.limit(0)
    tail = staged(waiting.where(F.col("_us") > bound), "tail") if bound is not None else waiting
    runs = staged(_runs(ripe, spec, threshold), "runs")
    seen = ripe.select(*spec.site).distinct().withColumn("_seen", F.lit(True))
    # an open event goes on in a run that begins with the site's first ripe row, else it has ended
    opened = match(state.open, staged(seen, "seen"), spec.site, "left")
    firsts = runs.where("_first").alias("r")
    same = None
    for c in spec.site:
        on = F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = on if same is None else same & on
    met = opened.alias("o").join(firsts, same if same is not None else F.lit(True), "full_outer")
    kept = [F.coalesce(F.col(f"o.{c}"), F.col(f"r.{c}")).alias(c) for c in spec.site]
    whole = met.select(*kept, *_joined("o", "r"), F.coalesce(F.col("o._seen"), F.lit(False)).alias("_seen"), F.col("r._last").alias("_last"))
    # open: the run goes to the end of the ripe rows, or the site had none of them
    goes_on = F.coalesce(F.col("_last"), ~F.col("_seen"))
    others = runs.where("NOT _first").withColumn("_on", F.col("_last")).drop("_first", "_last")
    events = staged(whole.withColumn("_on", goes_on).drop("_seen", "_last").select(*spec.site, *SUMS, "_on").unionByName(others.select(*spec.site, *SUMS, "_on")), "events")
    closed = events if last else events.where("NOT _on")
    following = events.limit(0) if last else events.where("_on")
    return _described(closed, spec), late, LiveState(tail, staged(following.drop("_on"), "open"), bound)


def events_of_arrivals(
    spark: SparkSession, arrivals: list[DataFrame], spec: SeriesSpec, strength: Column, threshold: float = 0.0, lateness_s: float = 0.0
) -> DataFrame:
    """The events of tables that arrive one after the other, all closed after the last."""
    state, found = start(arrivals[0], spec, strength), []
    for i, rows in enumerate(arrivals):
        closed, _, state = advance(state, rows, spec, strength, threshold, lateness_s, i == len(arrivals) - 1)
        found.append(staged(closed, "closed"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
