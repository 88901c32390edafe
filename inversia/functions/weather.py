"""Row-wise meteorology as ``{name: Column}`` groups; everything stays inside one projection."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in code order, and the upper (closed) edge of each class but the last.
STRENGTH_CLASSES = ("strong_lapse", "weak_lapse", "neutral", "weak_inversion", "strong_inversion")
STRENGTH_EDGES = (-2.0, 0.0, 2.0, 5.0)
# Metres between the sensor levels 05-20, 20-90 and 05-90.
LEVEL_GAPS = {"05_20": 15, "20_90": 70, "05_90": 85}


def flag(condition: Column) -> Column:
    """0/1 where an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def strength_code(strength: Column) -> Column:
    """Right-closed class code 0..4, null for null."""
    code = F.when(strength <= STRENGTH_EDGES[0], 0.0)
    for k, edge in enumerate(STRENGTH_EDGES[1:], start=1):
        code = code.when(strength <= edge, float(k))
    return code.when(strength.isNotNull(), float(len(STRENGTH_EDGES)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def between(value: Column, low: float, high: float) -> Column:
    """Clip that keeps null null (least and greatest skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def inversion_columns(have: Collection[str]) -> dict[str, Column]:
    """Level differences, strength flags and classes, gradients, ratio and curvature."""
    if not {"VT05", "VT20", "VT90"} <= set(have):
        return {}
    v05, v20, v90 = F.col("VT05"), F.col("VT20"), F.col("VT90")
    full, upper, lower = v90 - v05, v90 - v20, v20 - v05
    code = strength_code(full)
    gradient = full / LEVEL_GAPS["05_90"]
    return {
        "VT_inversion_90_05": full,
        "VT_inversion_90_20": upper,
        "VT_inversion_20_05": lower,
        "strong_inversion": flag(full > 0),
        "very_strong_inversion": flag(full > 2.0),
        "inversion_strength_numeric": code,
        **{f"inversion_type_{n}": flag(code == k) for k, n in enumerate(STRENGTH_CLASSES)},
        "VT_gradient_05_20": lower / LEVEL_GAPS["05_20"],
        "VT_gradient_20_90": upper / LEVEL_GAPS["20_90"],
        "VT_gradient_05_90": gradient,
        "stability_index": gradient * 1000,
        "boundary_layer_strength": F.abs(full),
        "VT20_VT90_ratio": ratio(v20, v90),
        "VT_profile_curvature": upper - lower,
    }


def wind_components(speed: Column, direction: Column) -> dict[str, Column]:
    angle = F.radians(direction)
    return {"wind_u": -speed * F.sin(angle), "wind_v": -speed * F.cos(angle)}


def surface_columns(have: Collection[str]) -> dict[str, Column]:
    """Dew-point spread, wind components, daylight."""
    out: dict[str, Column] = {}
    if {"TAIR", "DWPT"} <= set(have):
        out["temp_dewpoint_spread"] = F.col("TAIR") - F.col("DWPT")
    if {"WSPD", "WDIR"} <= set(have):
        out.update(wind_components(F.col("WSPD"), F.col("WDIR")))
    if "SRAD" in have:
        out["is_daylight"] = flag(F.col("SRAD") > 10)
    return out


def soil_columns(have: Collection[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if {"ST02", "ST04"} <= set(have):
        out["soil_temp_gradient"] = F.col("ST04") - F.col("ST02")
    if {"SM02", "SM04"} <= set(have):
        out["soil_moisture_gradient"] = F.col("SM04") - F.col("SM02")
    for depth in ("02", "04"):
        if {f"ST{depth}", "TAIR"} <= set(have):
            out[f"soil_air_temp_diff_{depth}"] = F.col(f"ST{depth}") - F.col("TAIR")
    return out


def potential_temperature(t: Column, p: Column) -> Column:
    return F.when(p > 0, t * F.pow(F.try_divide(F.lit(1000.0), p), F.lit(0.286)))


def saturation_pressure(t: Column) -> Column:
    bounded = between(t, -50, 60)
    return 6.112 * F.exp(17.67 * bounded / (bounded + 243.5))


def vapour_pressure(t: Column, rh: Column) -> Column:
    return F.when(rh >= 0, saturation_pressure(t) * between(rh, 0, 100) / 100)


def virtual_temperature(t: Column, rh: Column, p: Column) -> Column:
    return F.when(p > 0, t * (1 + F.try_divide(0.61 * vapour_pressure(t, rh), p)))


def physics_columns(have: Collection[str]) -> dict[str, Column]:
    t, rh, p = F.col("TAIR"), F.col("RELH"), F.col("PRES")
    out: dict[str, Column] = {}
    if {"TAIR", "PRES"} <= set(have):
        out["potential_temp"] = potential_temperature(t, p)
    if "TAIR" in have:
        out["sat_vapor_pressure"] = saturation_pressure(t)
    if {"TAIR", "RELH"} <= set(have):
        out["vapor_pressure"] = vapour_pressure(t, rh)
    if {"TAIR", "RELH", "PRES"} <= set(have):
        out["virtual_temp_calc"] = virtual_temperature(t, rh, p)
    return out


def interaction_columns(have: Collection[str]) -> dict[str, Column]:
    pairs = {
        "temp_humidity_interaction": ("TAIR", "RELH"),
        "solar_temp_interaction": ("SRAD", "TAIR"),
        "pressure_temp_interaction": ("PRES", "TAIR"),
    }
    out = {n: F.col(a) * F.col(b) for n, (a, b) in pairs.items() if {a, b} <= set(have)}
    if {"WSPD", "TAIR"} <= set(have):
        out["wind_temp_interaction"] = F.col("WSPD") * (F.col("TAIR") - 10)
    return out
