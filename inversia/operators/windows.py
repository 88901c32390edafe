"""Lags, leads, rolling statistics, differences, inversion events and the clean-up of extremes.

All window columns of a table are built in one ``select`` over one window specification, which
Spark plans as one exchange, one sort and one Window node."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from inversia.functions.calendar import season_name
from inversia.functions.coercion import existing, finite
from inversia.operators.quantiles import quantile_table
from inversia.plans.joins import match
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec, micros

# Step counts of the final feature build.
LAGS = (1, 2, 3, 6, 12)
ROLLING = (3, 6, 12)
HORIZONS = (1, 3, 6, 12)


class Frames:
    """Window values of one ordered window, each named and computed once.

    Features ask for lags and leads and combine the returned columns; a lag that is also a
    difference is one window function. ``made``: what several features share of such combinations
    (a mean that its deviations need), made between window and features."""

    def __init__(self, w: WindowSpec):
        self.w = w
        self.raw: dict[str, Column] = {}
        self.made: dict[str, Column] = {}

    def _value(self, name: str, make) -> Column:
        if name not in self.raw:
            self.raw[name] = make()
        return F.col(name)

    def lag(self, c: str, k: int = 1) -> Column:
        return self._value(f"_lag_{k}_{c}", lambda: F.lag(c, k).over(self.w))

    def lead(self, c: str, k: int) -> Column:
        return self._value(f"_lead_{k}_{c}", lambda: F.lead(c, k).over(self.w))

    def last_rows(self, c: str, n: int) -> list[Column]:
        """The values of the last n rows, oldest first, null before the first row. (A frame of n rows
        would be aggregated anew, all n of them, for every row and statistic.)"""
        return [*[self.lag(c, k) for k in range(n - 1, 0, -1)], F.col(c)]

    def mean(self, c: str, n: int) -> Column:
        """Of the last n rows, null unless all are known."""
        name = f"_mean_{n}_{c}"
        self.made[name] = reduce(Column.__add__, [x.cast("double") for x in self.last_rows(c, n)]) / F.lit(float(n))
        return F.col(name)

    def step(self, c: str, k: int = 1) -> Column:
        return F.col(c) - self.lag(c, k)

    def second_step(self, c: str) -> Column:
        """Difference of differences, written out so that windows do not nest."""
        return (F.col(c) - self.lag(c, 1)) - (self.lag(c, 1) - self.lag(c, 2))

    def turn(self, c: str) -> Column:
        """Direction change wrapped to (-180, 180]."""
        d = self.step(c)
        return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def lag_columns(columns: Sequence[str], f: Frames, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag_{k}": f.lag(c, k) for c in columns for k in lags}


def target_columns(columns: Sequence[str], f: Frames, horizons: Sequence[int] = HORIZONS) -> dict[str, Column]:
    return {f"{c}_target_{h}h": f.lead(c, h) for c in columns for h in horizons}


def rolling_columns(columns: Sequence[str], f: Frames, sizes: Sequence[int] = ROLLING) -> dict[str, Column]:
    """Statistics of the last n rows, null unless all n are known, and the change over n rows."""
    out: dict[str, Column] = {}
    for c in columns:
        for n in sizes:
            last, mean = f.last_rows(c, n), f.mean(c, n)
            squares = [(x - mean) * (x - mean) for x in last]
            out[f"{c}_rolling_mean_{n}"] = mean
            out[f"{c}_rolling_std_{n}"] = F.sqrt(reduce(Column.__add__, squares) / F.lit(n - 1.0)) if n > 1 else F.lit(None).cast("double")
            out[f"{c}_rolling_min_{n}"] = F.when(mean.isNotNull(), F.least(*last) if n > 1 else last[0])
            out[f"{c}_rolling_max_{n}"] = F.when(mean.isNotNull(), F.greatest(*last) if n > 1 else last[0])
            out[f"{c}_rolling_change_{n}"] = f.step(c, n)
    return out


def difference_columns(have: Sequence[str], f: Frames) -> dict[str, Column]:
    """First and second differences of the sensors that are present."""
    rules = {
        "temp_change_1h": ("TAIR", f.step),
        "temp_change_3h": ("TAIR", lambda c: f.step(c, 3)),
        "temp_acceleration": ("TAIR", f.second_step),
        "pressure_tendency_1h": ("PRES", f.step),
        "pressure_tendency_3h": ("PRES", lambda c: f.step(c, 3) / 3),
        "pressure_acceleration": ("PRES", f.second_step),
        "wind_speed_change": ("WSPD", f.step),
        "wind_direction_change": ("WDIR", f.turn),
        "solar_rad_change": ("SRAD", f.step),
        "humidity_change": ("RELH", f.step),
        "soil_temp_change_02": ("ST02", f.step),
        "soil_temp_change_04": ("ST04", f.step),
    }
    return {name: make(c) for name, (c, make) in rules.items() if c in have}


def add_windowed(df: DataFrame, spec: SeriesSpec, build, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Add the columns ``build(frames) -> {name: Column}``; frames may reach ``lookback`` rows
    back and ``lookahead`` rows forward."""
    layout = plan_layout(df, spec)
    rows = layout.spread(df, lookback, lookahead)
    frames = Frames(layout.window)
    added = build(frames)
    valued = layout.own(rows.select("*", *[c.alias(n) for n, c in frames.raw.items()]))
    if frames.made:
        valued = valued.select("*", *[c.alias(n) for n, c in frames.made.items()])
    return valued.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def add_lags(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], lags: Sequence[int] = LAGS) -> DataFrame:
    cols = existing(df, columns)
    return add_windowed(df, spec, lambda f: lag_columns(cols, f, lags), lookback=max(lags))


def add_targets(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    cols = existing(df, columns)
    return add_windowed(df, spec, lambda f: target_columns(cols, f, horizons), lookahead=max(horizons))


def add_rolling(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], sizes: Sequence[int] = ROLLING) -> DataFrame:
    cols = existing(df, columns)
    return add_windowed(df, spec, lambda f: rolling_columns(cols, f, sizes), lookback=max(sizes))


def add_differences(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return add_windowed(df, spec, lambda f: difference_columns(df.columns, f), lookback=3)


def inversion_events(df: DataFrame, spec: SeriesSpec, strength: Column, threshold: float = 0.0) -> DataFrame:
    """Runs of consecutive rows with strength above the threshold: when, how long, how strong.

    Rows of one event share the running count of the other rows, so after one ordered pass the
    event is a plain group-by whose state is one small record, however long the event is."""
    layout = plan_layout(df, spec)
    above = F.coalesce(F.col("_strength") > threshold, F.lit(False))
    rows = df.select(*spec.keys, micros(df, spec.ts).alias("_us"), strength.alias("_strength"))
    rows = layout.running(layout.spread(rows), _event=F.when(above, 0).otherwise(1))
    return (
        layout.own(rows)
        .where(above)
        .groupBy(*spec.site, "_event")
        .agg(
            F.min(spec.ts).alias("start_time"),
            F.max(spec.ts).alias("end_time"),
            F.count(F.lit(1)).alias("n_steps"),
            ((F.max("_us") - F.min("_us")) / F.lit(3.6e9)).alias("elapsed_hours"),
            F.max("_strength").alias("max_inversion_strength"),
            F.avg("_strength").alias("avg_inversion_strength"),
            season_name(F.month(F.min(spec.ts))).alias("season"),
        )
        .drop("_event")
    )


def event_summary(df: DataFrame, spec: SeriesSpec, strength: Column, threshold: float = 0.0) -> DataFrame:
    """Per site: steps, inversion steps and percent, events, strongest and mean inversion."""
    events = inversion_events(df, spec, strength, threshold)
    inverted = F.when(strength > threshold, strength)
    steps = df.groupBy(*spec.site).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count(inverted).alias("inversion_steps"),
        F.max(inverted).alias("strongest"),
        F.avg(inverted).alias("average_strength"),
    )
    per_site = events.groupBy(*spec.site).agg(F.count(F.lit(1)).alias("events"))
    if spec.site:
        joined = match(steps, per_site, spec.site, "left")
    else:
        joined = steps.withColumn("events", F.lit(per_site.first()["events"]))
    return joined.select(
        *spec.site,
        "steps",
        "inversion_steps",
        F.try_divide(F.col("inversion_steps") * 100.0, F.col("steps")).alias("inversion_pct"),
        F.coalesce("events", F.lit(0)).alias("events"),
        "strongest",
        "average_strength",
    )


def clean_extremes(
    df: DataFrame,
    columns: Sequence[str],
    cap_columns: Sequence[str] = (),
    cap_trigger: float = 1e10,
    any_trigger: float = 1e30,
) -> DataFrame:
    """Infinities and NaN become null. A column is capped to its 0.1 % and 99.9 % quantiles if it
    holds a value beyond ``any_trigger`` or, for ``cap_columns``, if a quantile passes
    ``cap_trigger``. One aggregate finds the few columns that need quantiles at all."""
    cols = existing(df, columns)
    if not cols:
        return df
    clean = df.withColumns({c: finite(F.col(c)) for c in cols})
    peaks = clean.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first().asDict()
    capped = set(cap_columns)
    suspects = [
        c for c in cols if peaks[c] is not None and peaks[c] > (min(cap_trigger, any_trigger) if c in capped else any_trigger)
    ]
    if not suspects:
        return clean
    caps = quantile_table(clean, suspects, {"lower": 0.001, "upper": 0.999})
    changed = {}
    for c in suspects:
        low, high = caps[c]["lower"], caps[c]["upper"]
        if peaks[c] > any_trigger or abs(low) > cap_trigger or abs(high) > cap_trigger:
            x = F.col(c)
            changed[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
    return clean.withColumns(changed) if changed else clean
