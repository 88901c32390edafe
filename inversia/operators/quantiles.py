"""Exact quantiles of any number of columns and groups without holding a group in one task.

A large table is bracketed first: a mergeable sketch names two values that each wanted rank surely
lies between, one pass counts what is below and between, and only the rows between are looked at
further. If a count shows that a bracket doesn't hold its rank, that group is done without brackets.
Equal values are counted map-side (sensors report few distinct values), then the distinct values of
each group are walked in order with the same chunk layout that series use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.plans.joins import match
from inversia.plans.layout import plan_layout
from inversia.plans.series import ROWS_PER_CHUNK, SeriesSpec
from inversia.session import staged

#: Tables of fewer values are counted whole, which is quicker than three passes.
BRACKET_FROM = 5_000_000
#: The sketch's accuracy (a rank is off by n / SKETCH at most), and how far a bracket reaches to either side.
SKETCH, REACH = 10_000, 2.0


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    bracket_from: int | None = None,
) -> DataFrame:
    """One row per (by..., variable) with a linearly interpolated quantile per name.

    Tables of at least ``bracket_from`` values (BRACKET_FROM) shuffle only values near the wanted
    ranks."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(*by, F.inline(F.filter(cells, lambda x: x["_v"].isNotNull())))
    group = [*by, "variable"]
    least = BRACKET_FROM if bracket_from is None else bracket_from
    # written once: counting the values and each pass over them reads one column, not the table again
    long = staged(long, "values")
    if probabilities and long.count() >= least:
        return _bracketed(long, group, probabilities, rows_per_chunk)
    # written once: planned, summed and walked without going over the table again
    counts = staged(long.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    return _walked(counts, totals, group, probabilities, rows_per_chunk)


def _bracketed(long: DataFrame, group: list[str], probabilities: dict[str, float], rows_per_chunk: int) -> DataFrame:
    """One bracket for each quantile: the values between two values of the sketch. Its rank among
    them is its rank among all less the number of values below the bracket."""
    slack, names = REACH / SKETCH, list(probabilities)
    points = sorted({min(1.0, max(0.0, p + d)) for p in probabilities.values() for d in (-slack, slack)})
    place = {p: i for i, p in enumerate(points)}
    sketch = long.groupBy(*group).agg(
        F.percentile_approx("_v", [float(p) for p in points], SKETCH).alias("_q"), F.count("*").alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    spans = []
    for name, p in probabilities.items():
        low = F.col("_min") if p - slack <= 0 else F.col("_q")[place[p - slack]]
        high = F.col("_max") if p + slack >= 1 else F.col("_q")[place[p + slack]]
        spans.append(F.struct(F.lit(name).alias("name"), low.alias("low"), high.alias("high")))
    sketch = staged(sketch.select(*group, "_total", F.array(*spans).alias("_spans")), "sketch")
    met = match(long, sketch, group)
    low, high = ([F.col("_spans")[i][e] for i in range(len(names))] for e in ("low", "high"))
    counted = met.groupBy(*group).agg(
        *[F.count(F.when(F.col("_v") < low[i], 1)).alias(f"_b{i}") for i in range(len(names))],
        *[F.count(F.when((F.col("_v") >= low[i]) & (F.col("_v") <= high[i]), 1)).alias(f"_w{i}") for i in range(len(names))],
    )
    checked = match(sketch, counted, group)
    holds = F.lit(True)
    for i, p in enumerate(probabilities.values()):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        holds = holds & (F.floor(rank) >= F.col(f"_b{i}")) & (F.ceil(rank) < F.col(f"_b{i}") + F.col(f"_w{i}"))
    checked = staged(checked.withColumn("_holds", holds), "checked")
    # each bracket is a group of its own; its totals are those of all its group's values
    good = checked.where("_holds")
    spans = F.filter("_spans", lambda s: (F.col("_v") >= s["low"]) & (F.col("_v") <= s["high"]))
    near = match(long, good.select(*group, "_spans"), group).select(*group, "_v", F.explode(F.transform(spans, lambda s: s["name"])).alias("_name"))
    counts = staged(near.groupBy(*group, "_name", "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    below = good.select(*group, "_total", F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(f"_b{i}").alias("_below")) for i, n in enumerate(names)])))
    found = _walked(counts, below, [*group, "_name"], probabilities, rows_per_chunk)
    # of each bracket only its own quantile means something
    own = [F.max(F.when(F.col("_name") == n, F.col(n))).alias(n) for n in names]
    found = found.groupBy(*group).agg(*own)
    rest = checked.where("NOT _holds").select(*group)
    if rest.isEmpty():
        return found
    left = match(long, rest.withColumn("_open", F.lit(True)), group).drop("_open")
    counts = staged(left.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    return found.unionByName(_walked(counts, totals, group, probabilities, rows_per_chunk))


def _walked(counts: DataFrame, totals: DataFrame, group: list[str], probabilities: dict[str, float], rows_per_chunk: int) -> DataFrame:
    """The quantiles from counts of values and, for each group, ``_total`` (of all its values) and
    perhaps ``_below`` (how many of them lie below the counted ones)."""
    totals = totals if "_below" in totals.columns else totals.withColumn("_below", F.lit(0).cast("long"))
    layout = plan_layout(counts, SeriesSpec(tuple(group), "_v", rows_per_chunk=rows_per_chunk))
    walked = layout.own(layout.running(layout.spread(counts), _cum=F.col("_n")))
    placed = match(walked, totals, group)

    def at(position: Column) -> Column:
        here = (F.col("_cum") - F.col("_n") + F.col("_below") <= position) & (position < F.col("_cum") + F.col("_below"))
        return F.max(F.when(here, F.col("_v")))

    aggs, values = [F.first("_total").alias("_total")], []
    for name, p in probabilities.items():
        exact = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [at(F.floor(exact)).alias(f"_lo_{name}"), at(F.ceil(exact)).alias(f"_hi_{name}")]
        part = exact - F.floor(exact)
        values.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part).alias(name))
    return placed.groupBy(*group).agg(*aggs).select(*group, *values)


def quantile_table(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> dict[str, dict]:
    """The quantiles of a few columns as a driver dictionary: one row per column."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, probabilities).collect()
    return {r["variable"]: {n: r[n] for n in probabilities} for r in rows}
