"""Range images: the nearest range of every direction bin of a scan, sparse.

A bin without a row was empty; whether the scanner looked there follows from
the scan's stored no-returns, or else from its field of view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import direction, direction_bin
from ..params import Thresholds

HIT, NO_RETURN, OUTSIDE = "HIT", "NO_RETURN", "OUTSIDE_FOV"
MOST_CM = 65_535


def range_cm(r: Column) -> Column:
    """Centimetres, halves rounded up, held by 16 bits."""
    return F.least(F.floor(r * 100.0 + 0.5), F.lit(MOST_CM)).cast("int")


def binned(points: DataFrame, t: Thresholds) -> DataFrame:
    """Scanner-local points with range and bins; those on the scanner itself have no direction."""
    rr, az, polar = direction(*map(F.col, "xyz"))
    near = points.withColumn("rr", rr).where("rr >= 1e-6").withColumns({"a": az, "p": polar})
    ia, ie = direction_bin(F.col("a"), F.col("p"), t)
    return near.withColumns({"ia": ia, "ie": ie})


def range_bins(points: DataFrame, t: Thresholds) -> DataFrame:
    """scan_id, ia, ie, range_cm: the least of each bin."""
    valid = points.where(F.coalesce("invalid_state", F.lit(0)) == 0)
    return binned(valid, t).groupBy("scan_id", "ia", "ie").agg(range_cm(F.min("rr")).alias("range_cm"))


def azimuth_gaps(bins: DataFrame, n_az: int) -> DataFrame:
    """Per scan and occupied azimuth bin: how far the next one is, around the circle."""
    seen = bins.select("scan_id", "ia").distinct()
    w = Window.partitionBy("scan_id").orderBy("ia")
    whole = Window.partitionBy("scan_id")
    return seen.select("scan_id", "ia", F.coalesce(F.lead("ia").over(w), F.min("ia").over(whole) + n_az).alias("next")).withColumn("gap", F.col("next") - F.col("ia"))


def field_of_view(bins: DataFrame, n_az: int) -> DataFrame:
    """Per scan: elevation bins from and to, first azimuth bin and extent.

    The azimuth extent is what the widest gap leaves; the circle is full if
    that is under two bins.
    """
    widest = azimuth_gaps(bins, n_az).groupBy("scan_id").agg(F.max(F.struct("gap", F.negate("ia").alias("back"), "next")).alias("g"))
    height = bins.groupBy("scan_id").agg(F.min("ie").alias("ie_from"), F.max("ie").alias("ie_to"))
    full = F.col("g.gap") < 2
    return height.join(widest, "scan_id").select("scan_id", "ie_from", "ie_to", F.when(full, 0).otherwise(F.col("g.next") % n_az).alias("ia_from"), F.when(full, n_az).otherwise(n_az - F.col("g.gap") + 1).alias("ia_extent"))


def empty_status(explicit: Column, no_return: Column, ia: Column, ie: Column, n_az: int) -> Column:
    """Status of a bin without a hit: stored no-returns decide if the scan has any, else its field of view."""
    inside = ie.between(F.col("ie_from"), F.col("ie_to")) & ((ia - F.col("ia_from") + n_az) % n_az < F.col("ia_extent"))
    return F.when(F.when(explicit, no_return).otherwise(inside), NO_RETURN).otherwise(OUTSIDE)


def status_image(points: DataFrame, t: Thresholds, stores_no_returns: Column) -> DataFrame:
    """scan_id, ia, ie, status, range_cm of every bin of every scan that has a hit."""
    bins = range_bins(points, t)
    lost = binned(points.where(stores_no_returns & (F.coalesce("invalid_state", F.lit(0)) != 0)), t).select("scan_id", "ia", "ie").distinct().withColumn("lost", F.lit(True))
    fov = field_of_view(bins, t.n_az).join(lost.select("scan_id").distinct().withColumn("explicit", F.lit(True)), "scan_id", "left")
    cells = fov.withColumn("ia", F.explode(F.sequence(F.lit(0), F.lit(t.n_az - 1)))).withColumn("ie", F.explode(F.sequence(F.lit(0), F.lit(t.n_el - 1))))
    all_ = cells.join(bins, ["scan_id", "ia", "ie"], "left").join(lost, ["scan_id", "ia", "ie"], "left")
    empty = empty_status(F.coalesce("explicit", F.lit(False)), F.coalesce("lost", F.lit(False)), F.col("ia"), F.col("ie"), t.n_az)
    return all_.select("scan_id", "ia", "ie", F.when(F.col("range_cm").isNotNull(), HIT).otherwise(empty).alias("status"), "range_cm")


def write_cache(bins: DataFrame, path: str) -> None:
    """Range images as files by scan, rows in order of direction, so that a few scans or bins can be read by themselves."""
    bins.repartition("scan_id").sortWithinPartitions("scan_id", "ie", "ia").write.partitionBy("scan_id").mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ia int, ie int, range_cm int, scan_id int").parquet(path).select("scan_id", "ia", "ie", "range_cm")


def mip(bins: DataFrame, levels: int) -> DataFrame:
    """Least and greatest range of every 2 x 2 bins, level after level (never a mean)."""
    level = bins.select("scan_id", "ia", "ie", F.col("range_cm").alias("lo"), F.col("range_cm").alias("hi"))
    out = None
    for k in range(1, levels + 1):
        level = level.groupBy("scan_id", F.floor(F.col("ia") / 2).cast("int").alias("ia"), F.floor(F.col("ie") / 2).cast("int").alias("ie")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = level.withColumn("level", F.lit(k)) if out is None else out.unionByName(level.withColumn("level", F.lit(k)))
    return out
