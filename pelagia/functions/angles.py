"""Circular arithmetic as column expressions; angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap360(x: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def wrap180(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def mean_of(sin_mean: Column, cos_mean: Column, low: float = 0.0) -> Column:
    """The direction of a mean vector in [low, low + 360); what lies within 1e-8 of the top becomes `low`."""
    angle = F.pmod(F.degrees(F.atan2(sin_mean, cos_mean)) - low, F.lit(360.0))
    return F.when(angle > 360.0 - 1e-8, F.lit(0.0)).otherwise(angle) + low


def circular_mean(x: Column, low: float = 0.0) -> Column:
    """Aggregate: circular mean of angles, NULL without values."""
    return mean_of(F.avg(F.sin(F.radians(x))), F.avg(F.cos(F.radians(x))), low)


def resultant_length(x: Column) -> Column:
    """Aggregate: mean resultant length, 0 (spread) to 1 (all alike)."""
    return F.sqrt(F.pow(F.avg(F.sin(F.radians(x))), 2) + F.pow(F.avg(F.cos(F.radians(x))), 2))


def guarded_mean(x: Column, least: float = 0.1) -> Column:
    """Aggregate: circular mean, NULL where the resultant length is under `least`."""
    return F.when(resultant_length(x) >= least, circular_mean(x))


def over_frame(x: Column, frame, low: float = 0.0) -> Column:
    """Circular mean over a window frame."""
    return mean_of(F.avg(F.sin(F.radians(x))).over(frame), F.avg(F.cos(F.radians(x))).over(frame), low)
