"""Scalar functions over coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PI, Thresholds


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def spherical_to_cartesian(r: Column, az: Column, el: Column) -> tuple[Column, Column, Column]:
    """Elevation is measured from the XY plane."""
    return r * F.cos(el) * F.cos(az), r * F.cos(el) * F.sin(az), r * F.sin(el)


def direction(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(range, azimuth from 0 to 2 pi, angle from the pole)."""
    rr = norm(dx, dy, dz)
    return rr, F.atan2(dy, dx) + PI, F.acos(F.least(F.greatest(dz / rr, F.lit(-1.0)), F.lit(1.0)))


def bin_of(angle: Column, width: float, n: int) -> Column:
    """The bin of an angle, the last one holding what rounding puts past it."""
    return F.least(F.greatest(F.floor(angle / width), F.lit(0)), F.lit(n - 1)).cast("int")


def direction_bin(az: Column, polar: Column, t: Thresholds) -> tuple[Column, Column]:
    return bin_of(az, t.bin_rad, t.n_az), bin_of(polar, t.bin_rad, t.n_el)


def clamp_byte(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)).cast("int")


def intensity_grey(v: Column, low: Column, high: Column) -> Column:
    """Grey from 40 to 255 over the range seen; the value is held as float32."""
    span = F.when(high > low, high - low).otherwise(1.0)
    t = F.least(F.greatest((v.cast("float").cast("double") - low) / span, F.lit(0.0)), F.lit(1.0))
    return F.floor(40 + 215 * t).cast("int")


def rotate_back(q: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A vector turned by the inverse of a unit quaternion (w, x, y, z)."""
    w, a, b, c = (F.get(q, F.lit(i)) for i in range(4))
    a, b, c = -a, -b, -c
    tx, ty, tz = 2 * (b * z - c * y), 2 * (c * x - a * z), 2 * (a * y - b * x)
    return x + w * tx + b * tz - c * ty, y + w * ty + c * tx - a * tz, z + w * tz + a * ty - b * tx
