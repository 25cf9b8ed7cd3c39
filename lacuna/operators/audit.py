"""Audit of scans: what was decoded against what the file declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm
from .classify import has_field

# Texts of the report.
OK, MISMATCH, OUTSIDE = "OK", "*** MISMATCH ***", "*** OUTSIDE DECLARED BOUNDS ***"
FRAMES = {
    "none": "unknown (no points decoded)",
    "local": "scanner-local (apply pose)",
    "posed": "global (pose already applied)",
    "far": "global (identity pose, far from origin)",
    "unsure": "ambiguous — inspect manually",
}


def scan_stats(points: DataFrame) -> DataFrame:
    """Per scan: records, invalid ones, and extent and sums of the valid ones.

    NaN leaves an extent as it was, but not a sum.
    """
    valid = F.coalesce("invalid_state", F.lit(0)) == 0
    return points.groupBy("scan_id").agg(
        F.count("*").alias("decoded"),
        F.count_if(~valid).alias("invalid"),
        *[f(F.when(valid & ~F.isnan(c), F.col(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"],
        *[F.sum(F.when(valid, F.col(c))).alias(f"sum_{c}") for c in "xyz"],
    )


def invalid_field() -> Column:
    """The scan's invalid-state field: the Cartesian one first."""
    return F.when(has_field("cartesianInvalidState"), "cartesianInvalidState").when(has_field("sphericalInvalidState"), "sphericalInvalidState")


def no_return_report(scans: DataFrame, stats: DataFrame) -> DataFrame:
    both = scans.join(F.broadcast(stats), "scan_id", "left")
    n = F.coalesce("invalid", F.lit(0))
    return both.select(
        "scan_id",
        invalid_field().alias("field"),
        n.alias("invalid"),
        "record_count",
        F.coalesce(F.try_divide(n * 100.0, F.col("record_count").cast("double")), F.lit(0.0)).alias("pct"),
        F.when(invalid_field().isNull(), "no field").when(n == 0, "never set").otherwise("stored").alias("convention"),
    )


def bounds_check(scans: DataFrame, stats: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Whether the decoded extent lies within the declared one; null where nothing is declared or decoded."""
    both = scans.join(F.broadcast(stats), "scan_id", "left")
    within = F.lit(True)
    for c in "xyz":
        within = within & (F.col(f"min_{c}") >= F.col(f"{c}_min") - tolerance) & (F.col(f"max_{c}") <= F.col(f"{c}_max") + tolerance)
    within = F.when(F.col("has_cartesian_bounds"), within)
    return both.select("scan_id", within.alias("within"), F.when(within, OK).when(~within, OUTSIDE).alias("flag"))


def frame_guess(scans: DataFrame, stats: DataFrame, denominator: str = "decoded") -> DataFrame:
    """Which frame the points are in, by where their centroid lies.

    The sums are of valid records; they are divided by all decoded ones, or by
    the valid ones with ``denominator="valid"``.
    """
    n = F.col("decoded") if denominator == "decoded" else F.col("decoded") - F.col("invalid")
    both = scans.join(F.broadcast(stats), "scan_id", "left")
    center = norm(*(F.try_divide(F.col(f"sum_{c}"), n.cast("double")) for c in "xyz"))
    pose = norm(*(F.get("t", F.lit(i)) for i in range(3)))
    seen = F.coalesce(F.col("decoded") > F.col("invalid"), F.lit(False))
    guess = (
        F.when(~seen, FRAMES["none"])
        .when(center < 5.0, FRAMES["local"])
        .when((pose > 1.0) & (F.abs(center - pose) < 0.25 * pose), FRAMES["posed"])
        .when((pose < 1e-9) & (center > 50.0), FRAMES["far"])
        .otherwise(FRAMES["unsure"])
    )
    return both.select("scan_id", F.when(seen, center).alias("centroid"), pose.alias("pose"), guess.alias("frame"))


def failures(scans: DataFrame, stats: DataFrame, path: Column | None = None) -> DataFrame:
    """Files, files with problems, problems, and the exit status.

    A scan fails once if the count differs and once if it leaves its bounds.
    """
    checks = bounds_check(scans, stats).select("scan_id", F.when(~F.col("within"), 1).otherwise(0).alias("outside"))
    all_ = scans.withColumn("path", path if path is not None else F.lit("corpus")).join(F.broadcast(stats.select("scan_id", "decoded")), "scan_id", "left").join(F.broadcast(checks), "scan_id")
    short = F.when(F.coalesce("decoded", F.lit(0)) != F.col("record_count"), 1).otherwise(0)
    by_path = all_.groupBy("path").agg(F.sum(short + F.col("outside")).alias("problems"))
    return by_path.agg(F.count("*").alias("files"), F.count_if(F.col("problems") > 0).alias("files_failed"), F.sum("problems").alias("problems")).withColumn("exit_status", F.when(F.col("files_failed") > 0, 1).otherwise(0))


def audit(points: DataFrame, scans: DataFrame) -> DataFrame:
    """The report: one row per scan with every check."""
    stats = scan_stats(points)
    return (
        scans.select("scan_id", "name", "record_count")
        .join(stats.select("scan_id", "decoded"), "scan_id", "left")
        .join(no_return_report(scans, stats).select("scan_id", "invalid", "pct", "convention"), "scan_id")
        .join(bounds_check(scans, stats), "scan_id")
        .join(frame_guess(scans, stats).select("scan_id", "frame"), "scan_id")
        .withColumn("count_flag", F.when(F.coalesce("decoded", F.lit(0)) == F.col("record_count"), OK).otherwise(MISMATCH))
    )
