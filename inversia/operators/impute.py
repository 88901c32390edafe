"""Gap filling with window functions: bounded linear, circular, forward/backward, constants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.functions.coercion import existing, number
from inversia.operators.quantiles import quantile_table
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec

# Sensor groups of a station table, in fill order.
CONTINUOUS = ("TAIR", "DWPT", "PRES", "RELH", "SRAD")
WIND = ("WSPD", "WSSD", "WDIR", "WDSD")
PRECIPITATION = ("PRCP",)
SOIL = ("SM02", "SM04", "ST02", "ST04")
LEVELS = ("VT05", "VT20", "VT90", "VR05", "VR20", "VR90")
SENSORS = CONTINUOUS + WIND + PRECIPITATION + SOIL + LEVELS
DIRECTIONS = tuple(c for c in WIND if "DIR" in c)


def _bounded_linear(c: str, limit: int) -> Column:
    """The value between the nearest known neighbours by row position, if one of them is at most
    ``limit`` rows away; beyond the first or last known value the nearest one."""
    here, before, after = F.col("_at"), F.col(f"_prev_at_{c}"), F.col(f"_next_at_{c}")
    low, high = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
    near_before, near_after = here - before <= limit, after - here <= limit
    between = low + (high - low) * (here - before) / (after - before)
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(low.isNotNull() & high.isNotNull(), F.when(near_before | near_after, between))
        .when(high.isNull(), F.when(near_before, low))
        .otherwise(F.when(near_after, high))
    )


def linear_fill(
    df: DataFrame,
    spec: SeriesSpec,
    columns: Sequence[str],
    limit: int = 12,
    directions: Sequence[str] = DIRECTIONS,
    precipitation: Sequence[str] = PRECIPITATION,
) -> DataFrame:
    """Fill short gaps of all given columns in one ordered pass, each by its kind: directions on
    the circle, precipitation with zero, everything else linearly by row position."""
    cols = existing(df, columns)
    rain = [c for c in cols if c in set(precipitation)]
    round_ = [c for c in cols if c in set(directions)]
    plain = [c for c in cols if c not in set(rain) | set(round_)]
    out = df.withColumns({c: number(F.col(c)) for c in cols}) if cols else df
    if rain:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in rain})
    moving = plain + [f"_{part}_{c}" for c in round_ for part in ("cos", "sin")]
    if not moving:
        return out
    if round_:
        out = out.withColumns(
            {f"_{n}_{c}": f(F.radians(c)) for c in round_ for n, f in (("cos", F.cos), ("sin", F.sin))}
        )
    layout = plan_layout(out, spec)
    rows = layout.spread(out)
    rows = rows.withColumn("_at", layout.position())
    rows = layout.own(layout.carry(rows, moving, position="_at"))
    filled = {c: _bounded_linear(c, limit) for c in plain}
    for c in round_:
        angle = F.degrees(F.atan2(_bounded_linear(f"_sin_{c}", limit), _bounded_linear(f"_cos_{c}", limit)))
        filled[c] = F.coalesce(F.col(c), F.pmod(angle, F.lit(360.0)))
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def circular_fill(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], limit: int = 12) -> DataFrame:
    return linear_fill(df, spec, columns, limit, directions=columns)


def zero_fill(df: DataFrame, columns: Sequence[str] = PRECIPITATION) -> DataFrame:
    cols = existing(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols}) if cols else df


def forward_backward_fill(
    df: DataFrame,
    spec: SeriesSpec,
    columns: Sequence[str],
    limit: int = 6,
    precipitation: Sequence[str] = PRECIPITATION,
) -> DataFrame:
    """At most ``limit`` rows forward, then at most ``limit`` rows backward; precipitation only
    forward."""
    cols = existing(df, columns)
    if not cols:
        return df
    out = df.withColumns({c: number(F.col(c)) for c in cols})
    layout = plan_layout(out, spec)
    rows = layout.spread(out, lookback=limit, lookahead=limit)
    back, ahead = layout.window.rowsBetween(-limit, 0), layout.window.rowsBetween(0, limit)
    keep = [c for c in rows.columns if c not in cols]
    rows = rows.select(*keep, *[F.last(c, ignorenulls=True).over(back).alias(c) for c in cols])
    both = [c for c in cols if c not in set(precipitation)]
    if both:
        keep = [c for c in rows.columns if c not in both]
        rows = rows.select(*keep, *[F.first(c, ignorenulls=True).over(ahead).alias(c) for c in both])
    return layout.own(rows).select(*df.columns)


def fill_all(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Unbounded forward then backward fill within each series."""
    cols = existing(df, columns)
    if not cols:
        return df
    layout = plan_layout(df, spec)
    rows = layout.own(layout.carry(layout.spread(df), cols))
    filled = {c: F.coalesce(f"_prev_{c}", f"_next_{c}") for c in cols}
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """One value per column; columns without any known value are left out."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return {c: v for c, v in row.items() if v is not None}


def mean_fill(df: DataFrame, columns: Sequence[str], fit_rows: DataFrame | None = None) -> DataFrame:
    """Null to the column mean of ``fit_rows`` (by default of the table itself)."""
    values = means(df if fit_rows is None else fit_rows, existing(df, columns))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df


def median_fill(df: DataFrame, columns: Sequence[str], fit_rows: DataFrame | None = None) -> DataFrame:
    """Null to the exact column median of ``fit_rows``."""
    found = quantile_table(df if fit_rows is None else fit_rows, existing(df, columns), {"median": 0.5})
    values = {c: v["median"] for c, v in found.items()}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}) if values else df
