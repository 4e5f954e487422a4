"""Distances, bearings and local projections as column expressions; angles in degrees, lengths in km or m."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north in metres of a local equirectangular projection."""
    k = RADIUS_KM * 1000
    return F.radians(lon - lon0) * k * F.cos(F.radians(lat0)), F.radians(lat - lat0) * k


def from_local(east: Column, north: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    k = RADIUS_KM * 1000
    return lon0 + F.degrees(east / (k * F.cos(F.radians(lat0)))), lat0 + F.degrees(north / k)


def geodesic_km(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Distances on the WGS-84 ellipsoid (Vincenty's inverse formula), NumPy arrays."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2, diff = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2)), lon2 - lon1
    lam = diff
    for _ in range(60):
        ss = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(ss > 0, ss, 1), 0.0)
        c2 = 1 - sa**2
        c2m = np.where(c2 > 1e-15, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(c2 > 1e-15, c2, 1), 0.0)
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        new = diff + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        if np.all(np.abs(new - lam) < 1e-12):
            lam = new
            break
        lam = new
    w = c2 * (a**2 - b**2) / b**2
    k = (np.sqrt(1 + w) - 1) / (np.sqrt(1 + w) + 1)
    big_a, big_b = (1 + k**2 / 4) / (1 - k), k * (1 - 3 / 8 * k**2)
    ds = big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return b * big_a * (sigma - ds)
