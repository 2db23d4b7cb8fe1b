"""Spherical geometry and coordinates as native column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as C


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.EARTH_RADIUS_CLUSTER_M) -> Column:
    """Great-circle distance in metres."""
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lon * half_lon)
    return 2 * radius * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Finite and in range; false for nulls."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def wrap_degrees(x: Column) -> Column:
    """Into [-180, 180), also for negative values."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def unwrapped(lon: Column, reference: Column) -> Column:
    """Longitude on the same turn as the reference, so that means near the dateline stay there."""
    return reference + wrap_degrees(lon - reference)


def place_rank_radius(rank: Column) -> Column:
    """Metres for a geocoder's place rank; null where it is too coarse for a pin."""
    chain = F.when(rank >= C.PLACE_RANK_RADII[0][0], C.PLACE_RANK_RADII[0][1])
    for least, metres in C.PLACE_RANK_RADII[1:]:
        chain = chain.when(rank >= least, metres)
    return chain


def landmark_confidence(radius_m: Column) -> Column:
    chain = F.when(radius_m <= C.LANDMARK_CONFIDENCE[0][0], C.LANDMARK_CONFIDENCE[0][1])
    for most, confidence in C.LANDMARK_CONFIDENCE[1:]:
        chain = chain.when(radius_m <= most, confidence)
    return chain.otherwise(C.LANDMARK_CONFIDENCE_ELSE)
