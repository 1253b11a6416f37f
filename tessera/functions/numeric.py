"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the reference sphere in metres, and the metres of one of its degrees.
SPHERE_RADIUS_M, METRES_PER_DEGREE = 1_737_400.0, 30_323.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def valid(v: Column | str) -> Column:
    """A pixel that holds data: finite and above zero."""
    v = col(v)
    return v.isNotNull() & ~F.isnan(v) & (v > 0)


def half_even(x: Column) -> Column:
    """Rounded to a whole number, ties to even."""
    return F.rint(x).cast("long")


def horner(coefficients: Column, x: Column) -> Column:
    """A polynomial's value; coefficients with the highest power first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda acc, c: acc * x + c)


def affine(m: Sequence[float], x: Column, y: Column) -> tuple[Column, Column]:
    """(a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in m)
    return a * x + b * y + c, d * x + e * y + f


def wrap_longitude(lon: Column) -> Column:
    """Into [-180, 180]; both ends stay where they are."""
    turns_down = F.when(lon > 180, F.ceil((lon - 180) / 360)).otherwise(0)
    turns_up = F.when(lon < -180, F.ceil((-180 - lon) / 360)).otherwise(0)
    return lon + 360.0 * (turns_up - turns_down)


def equirectangular(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres on the reference sphere, standard parallel 0."""
    return F.radians(lon) * SPHERE_RADIUS_M, F.radians(lat) * SPHERE_RADIUS_M


def exposure_seconds(value: Column, unit: Column) -> Column:
    """A line exposure in seconds. A value over 10 given in ms is taken for microseconds."""
    unit = F.lower(F.coalesce(unit, F.lit("ms")))
    scale = F.when((unit == "ms") & (value > 10), 1e6).when(unit == "s", 1.0).when(unit.isin("microsec", "us", "µs"), 1e6).otherwise(1e3)
    return value / scale
