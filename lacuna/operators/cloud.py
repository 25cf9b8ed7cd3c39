"""Scans as decimated clouds: float32 offsets from a float64 origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp_byte, finite, intensity_grey
from ..functions.text import display_name
from ..params import LoadOptions


def decimate(points: DataFrame, scans: DataFrame, max_points: int) -> DataFrame:
    """Every k-th record, k = max(1, ceil(records / max)), then only valid and finite ones."""
    steps = scans.select("scan_id", F.greatest(F.ceil(F.col("record_count") / max(1, max_points)), F.lit(1)).alias("stride"))
    kept = points.join(F.broadcast(steps), "scan_id").where(F.col("record_idx") % F.col("stride") == 0).drop("stride")
    return kept.where((F.coalesce("invalid_state", F.lit(0)) == 0) & finite(*map(F.col, "xyz")))


def origins(kept: DataFrame) -> DataFrame:
    """Each scan's first kept point, the number of kept points and the intensities' range."""
    first = F.min_by(F.struct("x", "y", "z"), "record_idx")
    return kept.groupBy("scan_id").agg(first.alias("o"), F.count("*").alias("n"), F.min("intensity").alias("int_lo"), F.max("intensity").alias("int_hi")).select("scan_id", *[F.col(f"o.{c}").alias(f"o{c}") for c in "xyz"], "n", "int_lo", "int_hi")


def cloud_points(kept: DataFrame, heads: DataFrame, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Per kept point: float32 offsets from its scan's origin, and a colour.

    The scan's own colours if they are preferred and it has all three, else its
    intensity as grey if that is preferred and there, else white. (A field that
    a scan lacks is null for all of its points.)
    """
    near = kept.join(F.broadcast(heads), "scan_id")
    names = ("red", "green", "blue")
    coloured = F.lit(options.prefer_colour) & F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()
    lit_ = F.lit(options.prefer_intensity) & F.col("intensity").isNotNull()
    grey = intensity_grey(F.col("intensity"), F.col("int_lo"), F.col("int_hi"))
    rgb = [F.when(coloured, clamp_byte(F.col(c))).when(lit_, grey).otherwise(255) for c in names]
    return near.select("scan_id", "record_idx", *[(F.col(c) - F.col(f"o{c}")).cast("float").alias(f"d{c}") for c in "xyz"], *[v.alias(n) for n, v in zip("rgb", rgb)])


def cloud_bounds(kept: DataFrame, heads: DataFrame) -> DataFrame:
    """Extent of the offsets, as float32 of the float64 extremes."""
    near = kept.join(F.broadcast(heads), "scan_id")
    return near.groupBy("scan_id").agg(*[f(F.col(c) - F.col(f"o{c}")).cast("float").alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])


def setup_positions(heads: DataFrame, scans: DataFrame) -> DataFrame:
    """Where the scanner stood, from the cloud's origin."""
    both = heads.join(F.broadcast(scans.select("scan_id", "has_pose", "t")), "scan_id")
    return both.select("scan_id", F.col("has_pose").alias("has_setup"), *[(F.get("t", F.lit(i)) - F.col(f"o{c}")).cast("float").alias(f"s{c}") for i, c in enumerate("xyz")])


def load_clouds(points: DataFrame, scans: DataFrame, options: LoadOptions = LoadOptions()) -> tuple[DataFrame, DataFrame]:
    """(one row per cloud, one row per kept point)."""
    kept = decimate(points, scans, options.max_points)
    heads = origins(kept)
    clouds = heads.join(cloud_bounds(kept, heads), "scan_id").join(setup_positions(heads, scans), "scan_id").join(F.broadcast(scans.select("scan_id", display_name(F.col("name"), F.col("scan_id")).alias("name"), "record_count")), "scan_id")
    return clouds, cloud_points(kept, heads, options)


def scene_offsets(heads: DataFrame) -> DataFrame:
    """Each cloud's origin from the first cloud's, as float32 (one row per cloud)."""
    first = Window.orderBy("scan_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.select("scan_id", "n", *[(F.col(f"o{c}") - F.first(f"o{c}").over(first)).cast("float").alias(f"f{c}") for c in "xyz"])


def scene_bounds(bounds: DataFrame, offsets: DataFrame) -> DataFrame:
    """Extent of all clouds that have points, in float32; no row if there is none."""
    both = bounds.join(F.broadcast(offsets.where("n > 0")), "scan_id")
    out = both.agg(*[f(F.col(f"{n}_{c}") + F.col(f"f{c}")).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])
    return out.where(F.col("lo_x").isNotNull())
