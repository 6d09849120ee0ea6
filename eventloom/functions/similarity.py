"""Distances between events, and what turns them into one similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def dot(a: str, b: str) -> Column:
    """The inner product of two arrays of doubles, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle distance in whole kilometres, cut towards zero."""
    rad = lambda c: F.radians(F.col(c))
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return (F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).cast("long")


def calendar_days(a: str, b: str) -> Column:
    """Days between the dates of two timestamps, whatever their hours."""
    return F.abs(F.datediff(F.to_date(a), F.to_date(b))).cast("long")


def whole_days(earlier: str, later: str) -> Column:
    """Stretches of 24 hours from one timestamp to another, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("long")


def newer(u_time: str, u: str, v_time: str, v: str) -> Column:
    """Whether an edge may go from u to v: v is later, and of equal times the one with the larger number is the source."""
    return (F.col(u_time) < F.col(v_time)) | ((F.col(u_time) == F.col(v_time)) & (F.col(u) > F.col(v)))


#: Distance to similarity: inverse 1 / (1 + d), exponential exp(-d / alpha), linear 1 - d / max_distance (below 0 beyond it).
CONVERSIONS: dict[str, Callable[..., Column]] = {
    "inverse": lambda d: 1 / (1 + d),
    "exponential": lambda d, alpha=1.0: F.exp(-d / F.lit(float(alpha))),
    "linear": lambda d, max_distance=1.0: 1 - d / F.lit(float(max_distance)),
}

#: The same for arrays.
NUMPY_CONVERSIONS: dict[str, Callable[..., np.ndarray]] = {
    "inverse": lambda d: 1 / (1 + d),
    "exponential": lambda d, alpha=1.0: np.exp(-d / float(alpha)),
    "linear": lambda d, max_distance=1.0: 1 - d / float(max_distance),
}

#: How the three similarities become one.
FUSIONS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "multiply": lambda what, where, when: what * where * when,
    "sum": lambda what, where, when: (what + where + when) / 3,
    "what": lambda what, where, when: what,
    "where": lambda what, where, when: where,
    "when": lambda what, where, when: when,
}
