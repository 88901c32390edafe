"""Calendar columns. Each function returns ``{name: Column}`` so callers add them in one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inversia.plans.series import micros

# Season names in code order, and the season code of months 1..12.
SEASONS = ("winter", "spring", "summer", "fall")
SEASON_OF_MONTH = (0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0)


def season_code(month: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in SEASON_OF_MONTH]), month - 1)


def season_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEASONS]), season_code(month))


def calendar_parts(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_year": F.dayofyear(ts),
        "month": F.month(ts),
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
    }


def season_columns(ts: Column) -> dict[str, Column]:
    code = season_code(F.month(ts))
    flags = {f"season_{name}": (code == i).cast("int") for i, name in enumerate(SEASONS)}
    return {"season_numeric": code, **flags}


def _circle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def cyclic_columns(ts: Column, day: str = "doy") -> dict[str, Column]:
    """Hour of day and day of year on the unit circle; the filler calls the latter ``day_*``."""
    hour_sin, hour_cos = _circle(F.hour(ts), 24)
    day_sin, day_cos = _circle(F.dayofyear(ts), 365)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos, f"{day}_sin": day_sin, f"{day}_cos": day_cos}


def model_time_columns(df: DataFrame, ts: str) -> dict[str, Column]:
    """Epoch seconds and the coarse calendar columns used by the significance jobs."""
    col = F.col(ts)
    hour = F.hour(col)
    return {
        "timestamp_float": F.floor(micros(df, ts) / F.lit(1_000_000)).cast("bigint"),
        "hour": hour,
        "day_of_year": F.dayofyear(col),
        "month": F.month(col),
        "is_daytime": hour.between(6, 18).cast("int"),
    }
