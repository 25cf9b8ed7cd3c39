"""Scan files as the tables that the operators take: a catalogue and points.

Which fields hold a scan's positions and invalid states is chosen by its
prototype: Cartesian ones if all three are there, else spherical ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import spherical_to_cartesian
from ..sources import e2807
from .classify import has_field

CARTESIAN, SPHERICAL = ("cartesianX", "cartesianY", "cartesianZ"), ("sphericalRange", "sphericalAzimuth", "sphericalElevation")
FIELDS = (*CARTESIAN, *SPHERICAL, "cartesianInvalidState", "sphericalInvalidState", "intensity", "colorRed", "colorGreen", "colorBlue", "rowIndex", "columnIndex")
NAMED = {"intensity": "intensity", "colorRed": "red", "colorGreen": "green", "colorBlue": "blue", "rowIndex": "row_index", "columnIndex": "col_index"}


def read(spark: SparkSession, paths: list[str], mode: str, **options: str) -> DataFrame:
    e2807.register(spark)
    return spark.read.format("e2807").options(mode=mode, paths=json.dumps(paths), **options).load()


def has_all(names: tuple[str, ...]):
    out = F.lit(True)
    for n in names:
        out = out & has_field(n)
    return out


def catalogue(spark: SparkSession, paths: list[str], on_error: str = "FAILFAST") -> DataFrame:
    """One row per scan of all files, numbered from 0 in the order of paths and scans (scan_id)."""
    scans = read(spark, paths, "scans", on_error=on_error)
    # One small row per scan, so that a single task can number them.
    order = Window.orderBy("path", "scan_index")
    system = F.when(has_all(CARTESIAN), "cartesian").when(has_all(SPHERICAL), "spherical")
    return scans.withColumn("scan_id", (F.row_number().over(order) - 1).cast("int")).withColumn("position_system", system)


def points(spark: SparkSession, paths: list[str], scans: DataFrame, fields: tuple[str, ...] = FIELDS, on_error: str = "FAILFAST") -> DataFrame:
    """scan_id, record_idx, x, y, z, invalid_state and the attributes asked for; scans without positions have none."""
    raw = read(spark, paths, "points", fields=",".join(fields), on_error=on_error)
    keys = scans.where("position_system IS NOT NULL").select("path", "scan_index", "scan_id", "position_system")
    both = raw.join(F.broadcast(keys), ["path", "scan_index"])
    turned = spherical_to_cartesian(*(F.col(c) for c in SPHERICAL))
    here = F.col("position_system") == "cartesian"
    xyz = [F.when(here, F.col(c)).otherwise(t).alias(n) for n, c, t in zip("xyz", CARTESIAN, turned)]
    invalid = F.coalesce("cartesianInvalidState", "sphericalInvalidState").cast("int").alias("invalid_state")
    return both.select("scan_id", "record_idx", *xyz, invalid, *[F.col(f).alias(n) for f, n in NAMED.items() if f in fields])


def session(spark: SparkSession, paths: list[str], on_error: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(catalogue, points) of a session over several files; files that cannot be read are left out (mode audit names them)."""
    scans = catalogue(spark, paths, on_error)
    return scans, points(spark, paths, scans, on_error=on_error)


def append(one: tuple[DataFrame, DataFrame], more: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two sessions in one, the scans of the second numbered after those of the first."""
    after = one[0].agg((F.coalesce(F.max("scan_id"), F.lit(-1)) + 1).alias("after"))
    moved = [df.crossJoin(F.broadcast(after)).withColumn("scan_id", (F.col("scan_id") + F.col("after")).cast("int")).drop("after") for df in more]
    return one[0].unionByName(moved[0]), one[1].unionByName(moved[1])


def blocks(points: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """User code over blocks of points (Arrow batches, columns of one length); a block for which it gives None adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return points.mapInArrow(run, schema)
