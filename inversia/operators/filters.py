"""Projections and row filters. None of them shuffles more than a per-site aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inversia.functions.coercion import existing, number
from inversia.plans.joins import any_of, match
from inversia.plans.layout import plan_layout
from inversia.plans.series import SeriesSpec

# The study region, degrees, inclusive.
REGION = {"lon": (-89.813, -81.688), "lat": (36.188, 39.438)}
ID_COLUMNS = ("UTCTimestampCollected", "NetSiteAbbrev", "County")
ENCODED_PREFIXES = ("inversion_type_", "season_")
# What tells an inversion, best first.
INDICATORS = ("strong_inversion", "VT_inversion_90_20")
POINT_COLUMNS = ("key", "altitude", "dist", "hr", "latitude", "longitude")


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*existing(df, columns))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed column is known."""
    return df.na.drop(subset=list(columns))


def incomplete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one listed column is null."""
    return df.where(any_of(F.col(c).isNull() for c in columns))


def in_region(df: DataFrame, lat: str = "latitude", lon: str = "longitude", region: dict = REGION) -> DataFrame:
    """Inclusive bounding box; on parquet points the bounds reach the scan."""
    return df.where(F.col(lon).between(*region["lon"]) & F.col(lat).between(*region["lat"]))


def site_rows(df: DataFrame, site: str, value) -> DataFrame:
    return df.where(F.col(site) == F.lit(value))


def large_sites(df: DataFrame, site: Sequence[str], more_than: int = 100) -> DataFrame:
    """Rows of the sites with more than so many rows. A count per site and a semi join: rows of a
    big site are never gathered in one task (the join side is small or, if not, splits on skew)."""
    keep = df.groupBy(*site).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    return df.join(keep.drop("_n"), list(site), "left_semi")


def inversion_rows(df: DataFrame) -> DataFrame:
    """Inversion time steps only, by the best indicator the table has."""
    if "strong_inversion" in df.columns:
        return df.where(F.col("strong_inversion") == 1)
    if "VT_inversion_90_20" in df.columns:
        return df.where(F.col("VT_inversion_90_20") > 0)
    return df


def drop_outliers(df: DataFrame, target: str, by: Sequence[str] = (), threshold: float = 3.0) -> DataFrame:
    """Rows whose target is strictly within ``threshold`` sample deviations of the mean.

    Mean and deviation come from an aggregate that is joined back, not from a window over the
    site. Where the deviation is zero or unknown nothing is dropped but null targets."""
    stats = df.groupBy(*by).agg(F.avg(target).alias("_mean"), F.stddev_samp(target).alias("_std"))
    if by:
        joined = match(df, stats, by)
        mean, std = F.col("_mean"), F.col("_std")
    else:
        row = stats.first()
        joined, mean, std = df, F.lit(row["_mean"]).cast("double"), F.lit(row["_std"]).cast("double")
    z = F.abs(F.try_divide(F.col(target) - mean, std))
    keep = F.col(target).isNotNull() & ((F.coalesce(std, F.lit(0.0)) == 0) | (z < threshold))
    return joined.where(keep).select(*df.columns)


def point_columns(df: DataFrame, spec: SeriesSpec, ts: str = "timestamp") -> DataFrame:
    """Point table in its fixed column order. ``key`` counts the points of one file (``spec.site``)
    in pixel order (``spec.ts``) from 1; ``dist`` and ``hr`` are 0 unless the caller brings them."""
    layout = plan_layout(df, spec)
    keyed = layout.spread(df)
    keyed = layout.own(keyed.withColumn("key", layout.position() + 1))
    for name in ("altitude", "dist", "hr"):
        if name not in df.columns:
            keyed = keyed.withColumn(name, F.lit(0.0))
    fixed = {*POINT_COLUMNS, ts, *spec.keys}
    values = [c for c in df.columns if c not in fixed]
    return keyed.select(*[c for c in (*POINT_COLUMNS, *values, ts) if c in keyed.columns])


def missing_fractions(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of nulls of every column, in one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 1.0 for c in columns}


def select_features(
    df: DataFrame,
    targets: Sequence[str] = (),
    exclude_future: bool = True,
    max_missing: float = 0.5,
    ids: Sequence[str] = ID_COLUMNS,
) -> list[str]:
    """Model columns: no ids, no targets, no plain strings, and less than ``max_missing`` null."""
    text = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and not f.name.startswith(ENCODED_PREFIXES)
    }
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    future = {c for c in df.columns if "target_" in c} if exclude_future else set()
    out = {*ids, *targets, "inversion_strength", *text, *times, *future}
    candidates = [c for c in df.columns if c not in out]
    missing = missing_fractions(df, candidates)
    return [c for c in candidates if missing[c] < max_missing]


def all_but(df: DataFrame, target: str, ids: Sequence[str] = ID_COLUMNS) -> list[str]:
    """The simpler feature rule: everything but target, ids, times and unnamed index columns."""
    out = {target, *ids, "datetime", "timestamp"}
    return [c for c in df.columns if c not in out and not c.startswith("Unnamed")]


def numeric_only(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Drop text columns other than ids."""
    return df.drop(
        *[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ids]
    )


def coerce_leftovers(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Read the remaining text columns as numbers instead of dropping them."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in ids]
    return df.withColumns({c: number(F.col(c)) for c in text}) if text else df


def difference_targets(df: DataFrame) -> DataFrame:
    """Add TAIR_VT20 and VT90_VT20 and keep the rows that have both."""
    absent = [c for c in ("TAIR", "VT20", "VT90") if c not in df.columns]
    if absent:
        raise ValueError(f"missing input columns: {absent}")
    out = df.withColumns(
        {"TAIR_VT20": F.col("TAIR") - F.col("VT20"), "VT90_VT20": F.col("VT90") - F.col("VT20")}
    )
    return out.na.drop(subset=["TAIR_VT20", "VT90_VT20"])
