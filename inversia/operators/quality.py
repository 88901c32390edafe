"""Missing values, time gaps, continuous periods, completeness, and table comparison.

Runs are found without a self join: rows of one run share the running count of the rows that
break it, so a run is ``groupBy(site, that count)``, an aggregate with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inversia.functions.coercion import numeric_columns, parse_time
from inversia.plans.joins import all_of, match
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec, micros


def _long(row: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str], **fields) -> DataFrame:
    """Turn aggregates named ``<field>__<column>`` into one row per column."""
    items = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{f}__{c}").alias(f) for f in fields.values()]) for c in columns
    ]
    return row.select(*keys, F.inline(F.array(*items)))


def missing_map(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """1 where a cell is missing, 0 where not, next to the row's keys."""
    return df.select(*keys, *[F.col(c).isNull().cast("int").alias(c) for c in columns])


def _missing_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"known__{c}") for c in columns]]
    wide = df.groupBy(*by).agg(*aggs)
    items = [
        F.struct(F.lit(c).alias("variable"), (F.col("total") - F.col(f"known__{c}")).alias("missing"))
        for c in columns
    ]
    return wide.select(*by, "total", F.inline(F.array(*items)))


def missing_by_column(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing count and percent per column, most missing first."""
    counts = _missing_counts(df, columns, by).withColumn(
        "missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("total"))
    )
    return counts.orderBy(F.desc("missing"), "variable")


def missing_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells, missing cells and their percentage over the whole table."""
    counts = _missing_counts(df, columns)
    return counts.agg(F.sum("total").alias("cells"), F.sum("missing").alias("missing")).withColumn(
        "missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("cells"))
    )


def _by_read_time(raw: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, SeriesSpec]:
    """Text times are read into a helper column for the order and kept as they are; rows whose
    time can't be read come first, by their text."""
    if not isinstance(raw.schema[spec.ts].dataType, T.StringType):
        return raw, spec
    return raw.withColumn("_time", parse_time(F.col(spec.ts))), spec.but(ts="_time", tiebreak=(spec.ts, *spec.tiebreak))


def missing_log(raw: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """One row per cell of a raw text table that is not a number: when, where, what it was."""
    raw, ordered = _by_read_time(raw, spec)
    layout = plan_layout(raw, ordered)
    rows = layout.spread(raw)
    rows = layout.own(rows.withColumn("Row_Index", layout.position()))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("Column"),
                F.col(c).cast("string").alias("Original_Value"),
                F.col(c).try_cast("double").alias("_value"),
            )
            for c in columns
        ]
    )
    bad = F.filter(cells, lambda x: x["_value"].isNull() | F.isnan(x["_value"]))
    kind = F.when(F.col("Original_Value").isNotNull(), "Non-numeric_converted").otherwise("Already_missing")
    return (
        rows.select(*spec.site, F.col(spec.ts).alias("DateTime"), "Row_Index", F.inline(bad))
        .drop("_value")
        .withColumn("Missing_Type", kind)
    )


def missing_log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("Column").agg(F.count(F.lit(1)).alias("Count"))


def first_raw_values(raw: DataFrame, spec: SeriesSpec, columns: Sequence[str], first: int = 20) -> DataFrame:
    """The first ``first`` distinct raw values of each column, in order of appearance.

    Distinct values are combined map-side; the rank is a group-limited window, so of each column
    only ``first`` values per partition travel."""
    raw, spec = _by_read_time(raw, spec)
    order = F.struct(*[F.col(c) for c in spec.order])
    cells = F.array(
        *[F.struct(F.lit(c).alias("Column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("Value")) for c in columns]
    )
    seen = raw.select(order.alias("_at"), F.inline(cells)).groupBy("Column", "Value").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("Column").orderBy("_at", "Value"))
    return seen.withColumn("Seen_No", rank).where(F.col("Seen_No") <= first).drop("_at")


def missing_runs(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Every run of consecutive missing values: site, variable, start, end, length in rows.

    All variables share one sort; only missing cells leave it."""
    layout = plan_layout(df, spec)
    rows = layout.spread(df.select(*spec.keys, *[F.col(c).isNotNull().cast("int").alias(c) for c in columns]))
    rows = layout.running(rows, **{f"_run_{c}": F.col(c) for c in columns})
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("_known"), F.col(f"_run_{c}").alias("_run")) for c in columns]
    )
    missing = layout.own(rows).select(
        *spec.site, F.col(spec.ts).alias("_at"), F.inline(F.filter(cells, lambda x: x["_known"] == 0))
    )
    return (
        missing.groupBy(*spec.site, "variable", "_run")
        .agg(F.min("_at").alias("gap_start"), F.max("_at").alias("gap_end"), F.count(F.lit(1)).alias("gap_length"))
        .drop("_run")
    )


def gap_analysis(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """Per variable: rows, missing rows and percent, runs, longest and mean run. The run lengths
    themselves are the rows of ``missing_runs``, not an array that grows with the series."""
    by = list(spec.site if by is None else by)
    counts = _missing_counts(df, columns, by)
    runs = (
        missing_runs(df, spec, columns)
        .groupBy(*by, "variable")
        .agg(
            F.count(F.lit(1)).alias("number_of_gaps"),
            F.max("gap_length").alias("max_gap_length"),
            F.avg("gap_length").alias("avg_gap_length"),
        )
    )
    return match(counts, runs, (*by, "variable"), "left").select(
        *by,
        "variable",
        F.col("missing").alias("total_missing"),
        F.try_divide(F.col("missing") * 100.0, F.col("total")).alias("missing_percentage"),
        F.coalesce("number_of_gaps", F.lit(0)).alias("number_of_gaps"),
        F.coalesce("max_gap_length", F.lit(0)).alias("max_gap_length"),
        F.coalesce("avg_gap_length", F.lit(0.0)).alias("avg_gap_length"),
    )


def _numbered_steps(df: DataFrame, spec: SeriesSpec, expected_s: float, tolerance_s: float) -> DataFrame:
    """Own rows with the previous time, the step in seconds and the number of gaps up to the row."""
    layout = plan_layout(df, spec)
    rows = layout.spread(df.select(*spec.keys, micros(df, spec.ts).alias("_us")), lookback=1)
    w = layout.window
    rows = rows.withColumns(
        {
            "_prev": F.lag(spec.ts).over(w),
            "_step": (F.col("_us") - F.lag("_us").over(w)) / F.lit(1e6),
        }
    )
    rows = rows.withColumn("_is_gap", F.coalesce(F.col("_step") > expected_s + tolerance_s, F.lit(False)).cast("int"))
    return layout.own(layout.running(rows, _gap=F.col("_is_gap")))


def time_gaps(df: DataFrame, spec: SeriesSpec, expected_s: float = 1800, tolerance_s: float = 300) -> DataFrame:
    """Steps strictly longer than the expected interval plus tolerance."""
    steps = _numbered_steps(df, spec, expected_s, tolerance_s).where(F.col("_is_gap") == 1)
    return steps.select(
        *spec.site,
        F.col("_gap").alias("gap"),
        F.col("_prev").alias("gap_start"),
        F.col(spec.ts).alias("gap_end"),
        F.col("_step").alias("gap_seconds"),
        (F.floor(F.col("_step") / expected_s) - 1).alias("missing_records_est"),
    )


def continuous_periods(df: DataFrame, spec: SeriesSpec, expected_s: float = 1800, tolerance_s: float = 300) -> DataFrame:
    """The stretches between time gaps, numbered in time order."""
    steps = _numbered_steps(df, spec, expected_s, tolerance_s)
    return (
        steps.groupBy(*spec.site, (F.col("_gap") + 1).alias("period"))
        .agg(
            F.min(spec.ts).alias("start_date"),
            F.max(spec.ts).alias("end_date"),
            ((F.max("_us") - F.min("_us")) / F.lit(3.6e9)).alias("duration_hours"),
            F.count(F.lit(1)).alias("record_count"),
        )
    )


def completeness(df: DataFrame, spec: SeriesSpec, expected_s: float = 1800, tolerance_s: float = 300) -> DataFrame:
    """Span, data and gap hours, completeness percent and the longest period, per site."""
    steps = _numbered_steps(df, spec, expected_s, tolerance_s)
    periods = steps.groupBy(*spec.site, "_gap").agg(
        F.min("_us").alias("_us0"),
        F.max("_us").alias("_us1"),
        F.min(spec.ts).alias("start_date"),
        F.max(spec.ts).alias("end_date"),
    )
    length = F.col("_us1") - F.col("_us0")
    longest = F.max_by(
        F.struct("start_date", "end_date", length.alias("us")), F.struct(length, -F.col("_us0"))
    )
    hour = F.lit(3.6e9)
    total = periods.groupBy(*spec.site).agg(
        F.count(F.lit(1)).alias("periods"),
        (F.max("_us1") - F.min("_us0")).alias("_span"),
        F.sum(length).alias("_data"),
        longest.alias("_longest"),
    )
    return total.select(
        *spec.site,
        "periods",
        (F.col("_span") / hour).alias("span_hours"),
        (F.col("_data") / hour).alias("data_hours"),
        ((F.col("_span") - F.col("_data")) / hour).alias("gap_hours"),
        F.try_divide(F.col("_data") * 100.0, F.col("_span")).alias("completeness_pct"),
        (F.col("_longest")["us"] / hour).alias("longest_hours"),
        F.col("_longest")["start_date"].alias("longest_start"),
        F.col("_longest")["end_date"].alias("longest_end"),
    )


def _complete_runs(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]):
    layout = plan_layout(df, spec)
    complete = all_of(F.col(c).isNotNull() for c in columns).cast("int")
    rows = layout.spread(df.select(*spec.keys, complete.alias("_ok"), micros(df, spec.ts).alias("_us")))
    rows = rows.withColumn("_row", layout.position())
    rows = layout.running(rows, _good=F.col("_ok"), _bad=1 - F.col("_ok"))
    return layout.own(rows)


def _run_extent(spec: SeriesSpec) -> list[Column]:
    return [
        F.min("_row").alias("start_row"),
        F.max("_row").alias("end_row"),
        F.min(spec.ts).alias("start_time"),
        F.max(spec.ts).alias("end_time"),
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max("_us") - F.min("_us")) / F.lit(3.6e9)).alias("span_hours"),
    ]


def complete_chunks(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Runs of rows in which every key variable is present."""
    rows = _complete_runs(df, spec, columns).where(F.col("_ok") == 1)
    return rows.groupBy(*spec.site, "_bad").agg(*_run_extent(spec)).drop("_bad")


def chunk_gaps(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """The incomplete runs between two complete chunks (not before the first or after the last)."""
    rows = _complete_runs(df, spec, columns)
    good = df.where(all_of(F.col(c).isNotNull() for c in columns)).groupBy(*spec.site).agg(
        F.count(F.lit(1)).alias("_all_good")
    )
    runs = rows.where((F.col("_ok") == 0) & (F.col("_good") > 0)).groupBy(*spec.site, "_good").agg(*_run_extent(spec))
    if spec.site:
        runs = match(runs, good, spec.site)
    else:
        runs = runs.withColumn("_all_good", F.lit(good.first()["_all_good"]))
    return runs.where(F.col("_good") < F.col("_all_good")).drop("_good", "_all_good")


def chunk_summary(df: DataFrame, spec: SeriesSpec, columns: Sequence[str]) -> DataFrame:
    """Rows, complete rows and percent, and number of chunks, per site."""
    rows = df.groupBy(*spec.site).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(all_of(F.col(c).isNotNull() for c in columns), 1)).alias("complete_rows"),
    )
    chunks = complete_chunks(df, spec, columns).groupBy(*spec.site).agg(F.count(F.lit(1)).alias("chunks"))
    if not spec.site:
        return rows.withColumn("chunks", F.lit(chunks.first()["chunks"])).select(
            "total_rows",
            "complete_rows",
            F.try_divide(F.col("complete_rows") * 100.0, F.col("total_rows")).alias("complete_pct"),
            "chunks",
        )
    return match(rows, chunks, spec.site, "left").select(
        *spec.site,
        "total_rows",
        "complete_rows",
        F.try_divide(F.col("complete_rows") * 100.0, F.col("total_rows")).alias("complete_pct"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )


def availability(df: DataFrame, ts: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """First and last time and number of known values per variable, from one wide aggregate."""
    known = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in columns}
    wide = df.groupBy(*by).agg(
        *[x for c in columns for x in (
            F.min(known[c]).alias(f"first_time__{c}"),
            F.max(known[c]).alias(f"last_time__{c}"),
            F.count(c).alias(f"available__{c}"),
        )]
    )
    return _long(wide, by, "variable", columns, a="first_time", b="last_time", c="available")


def cell_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cells that differ between two tables aligned on their keys; null equals null."""
    both = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(
        b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns]), list(keys), "full_outer"
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(f"_a_{c}").alias("self"), F.col(f"_b_{c}").alias("other")) for c in columns]
    )
    return both.select(*keys, F.inline(F.filter(cells, lambda x: ~x["self"].eqNullSafe(x["other"]))))


def compare_columns(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference statistics of every numeric column two tables share, rows paired on keys."""
    common = [c for c in numeric_columns(a, keys) if c in set(numeric_columns(b, keys))]
    both = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in common]).join(
        b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in common]), list(keys)
    )
    diff = {c: F.col(f"_a_{c}") - F.col(f"_b_{c}") for c in common}
    wide = both.agg(
        *[x for c in common for x in (
            F.count(diff[c]).alias(f"pairs__{c}"),
            F.avg(diff[c]).alias(f"mean_diff__{c}"),
            F.stddev_samp(diff[c]).alias(f"std_diff__{c}"),
            F.max(F.abs(diff[c])).alias(f"max_abs_diff__{c}"),
        )]
    )
    return _long(wide, (), "variable", common, a="pairs", b="mean_diff", c="std_diff", d="max_abs_diff")


def fill_report(original: DataFrame, filled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing before and after a fill, per variable."""
    before = _missing_counts(original, columns).select("variable", "total", F.col("missing").alias("original_missing"))
    after = _missing_counts(filled, columns).select("variable", F.col("missing").alias("current_missing"))
    return before.join(after, "variable").select(
        "variable",
        "original_missing",
        F.try_divide(F.col("original_missing") * 100.0, F.col("total")).alias("original_pct"),
        "current_missing",
        F.try_divide(F.col("current_missing") * 100.0, F.col("total")).alias("current_pct"),
        (F.col("original_missing") - F.col("current_missing")).alias("filled"),
    )


def dataset_profile(df: DataFrame, site: str, ts: str, targets: Sequence[str]) -> DataFrame:
    """Rows, sites, date range, and moments of each target; one row per target, one aggregate."""
    wide = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct(site).alias("sites"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        *[x for c in targets for x in (
            F.avg(c).alias(f"mean__{c}"),
            F.stddev_samp(c).alias(f"std__{c}"),
            F.min(c).alias(f"min__{c}"),
            F.max(c).alias(f"max__{c}"),
        )],
    )
    keys = ("total_records", "sites", "start", "end")
    return _long(wide, keys, "target", targets, a="mean", b="std", c="min", d="max")


def coverage(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last time and rows of a (filtered) table."""
    return df.groupBy(*by).agg(
        F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), F.count(F.lit(1)).alias("n_rows")
    )
