"""Projection of points and picking of the nearest one under a pixel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .camera import FAR_DEPTH, OrbitCamera, inverse

# Colours of scans that have none of their own, and limits of a sprite's size in pixels.
TINTS = ((0.55, 0.78, 1.00), (1.00, 0.78, 0.45), (0.62, 0.90, 0.62), (0.94, 0.66, 0.86), (0.98, 0.92, 0.55), (0.70, 0.70, 0.95), (0.55, 0.92, 0.90), (0.92, 0.60, 0.55))
SMALLEST, LARGEST, LEAST_W = 1.0, 24.0, 1e-4


def product(m: np.ndarray, row: int, v: list[Column]) -> Column:
    """One row of a matrix times a vector, as literals."""
    out = None
    for c, x in zip(m[row].tolist(), v):
        out = x * c if out is None else out + x * c
    return out


def project(points: DataFrame, matrix: np.ndarray, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds clip_w and, for points before the camera, ndc_x, ndc_y and ndc_z."""
    v = [*(F.col(c).cast("double") for c in (x, y, z)), F.lit(1.0)]
    out = points.withColumn("clip_w", product(matrix, 3, v))
    ahead = F.col("clip_w") > 1e-6
    return out.withColumns({f"ndc_{c}": F.when(ahead, product(matrix, i, v) / F.col("clip_w")) for i, c in enumerate("xyz")})


def pick_nearest(points: DataFrame, camera: OrbitCamera, ndc_x: float, ndc_y: float, radius_px: float) -> DataFrame:
    """The point nearest to the camera within a disc around a pixel; no row if there is none."""
    rx, ry = 2 * radius_px / camera.width, 2 * radius_px / camera.height
    seen = project(points, camera.matrix()).where("ndc_x IS NOT NULL")
    dx, dy = (F.col("ndc_x") - ndc_x) / rx, (F.col("ndc_y") - ndc_y) / ry
    return seen.where(dx * dx + dy * dy <= 1.0).orderBy("clip_w", "scan_id", "record_idx").limit(1)


def unproject(readings: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Adds hit and the world point of depth readings (ndc_x, ndc_y, depth)."""
    back = inverse(matrix)
    v = [F.col("ndc_x"), F.col("ndc_y"), F.col("depth"), F.lit(1.0)]
    hit = F.col("depth") < float(FAR_DEPTH)
    w = product(back, 3, v)
    return readings.withColumns({"hit": hit} | {f"w{c}": F.when(hit, product(back, i, v) / w) for i, c in enumerate("xyz")})


def sprites(projected: DataFrame, size: float, attenuation: float) -> DataFrame:
    """Adds a point's sprite size in pixels and its scan's tint."""
    grown = F.lit(size * attenuation) / F.greatest(F.col("clip_w"), F.lit(LEAST_W))
    tints = F.array(*[F.array(*map(F.lit, t)) for t in TINTS])
    return projected.withColumns({"sprite": F.least(F.greatest(grown, F.lit(SMALLEST)), F.lit(LARGEST)), "tint": F.get(tints, F.col("scan_id") % len(TINTS))})
