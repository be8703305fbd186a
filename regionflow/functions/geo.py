"""Distances and pair weights as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from regionflow.constants import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def gravity_weight(
    pop_i: Column,
    pop_j: Column,
    km: Column,
    mul: Column,
    a: float = 0.2,
    b: float = 1.0,
    g: float = 1.2,
    k: float = 1e-6,
    min_km: float = 300.0,
) -> Column:
    """k * pop_i^a * pop_j^b * mul / max(min_km, km)^g."""
    return (
        F.lit(k)
        * F.pow(pop_i.cast("double"), F.lit(a))
        * F.pow(pop_j.cast("double"), F.lit(b))
        * mul
        / F.pow(F.greatest(F.lit(min_km), km), F.lit(g))
    )


def air_weight(
    src: dict[str, Column],
    dst: dict[str, Column],
    km: Column,
    alpha: float = 1.0,
    beta: float = 1.0,
    gamma: float = 1.6,
    air_blend: float = 0.5,
    step: Column | int = 0,
) -> Column:
    """Blend of airport and gravity weight, scaled by the two regions' profiles.

    `src` and `dst` map pop, airports, air_scale, connectivity, gdp, mobility
    and climate to columns.
    """
    step = step if isinstance(step, Column) else F.lit(step)
    mean = lambda name: (src[name] + dst[name]) / 2
    land = (
        F.pow(src["pop"] + F.lit(1e-6), F.lit(alpha))
        * F.pow(dst["pop"] + F.lit(1e-6), F.lit(beta))
        / F.pow(km + F.lit(1.0), F.lit(gamma))
    )
    air = F.sqrt((src["airports"] + 1.0) * (dst["airports"] + 1.0)) * src["air_scale"] * dst["air_scale"]
    season = F.lit(1.0) + F.lit(0.15) * F.sin(step * F.lit(math.pi / 180.0)) * mean("climate")
    return (
        (F.lit(air_blend) * air + F.lit(1.0 - air_blend) * land)
        * mean("connectivity")
        * (F.sqrt(src["gdp"] * dst["gdp"]) / F.lit(50000.0))
        * mean("mobility")
        * season
    )
