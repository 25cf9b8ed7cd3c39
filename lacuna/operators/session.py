"""A session: every scan judged, the usable ones loaded, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name, human_count
from ..params import LoadOptions, Thresholds
from .classify import STRUCTURED, classify
from .cloud import decimate


def report(points: DataFrame, scans: DataFrame, t: Thresholds = Thresholds(), options: LoadOptions = LoadOptions()) -> DataFrame:
    """One row per scan; only structured scans with points are rendered."""
    verdicts = classify(points, scans, t)
    usable = verdicts.where(F.col("kind") == STRUCTURED).select("scan_id")
    loaded = decimate(points.join(F.broadcast(usable), "scan_id", "left_semi"), scans, options.max_points).groupBy("scan_id").agg(F.count("*").alias("loaded"))
    all_ = verdicts.join(F.broadcast(scans.select("scan_id", "name", "record_count")), "scan_id").join(F.broadcast(loaded), "scan_id", "left")
    rendered = (F.col("kind") == STRUCTURED) & (F.coalesce("loaded", F.lit(0)) > 0)
    return all_.select(
        "scan_id",
        display_name(F.col("name"), F.col("scan_id")).alias("name"),
        "kind",
        "summary",
        F.array_join("evidence", "\n").alias("detail"),
        F.col("record_count").alias("source_points"),
        F.coalesce("loaded", F.lit(0)).alias("loaded_points"),
        rendered.alias("rendered"),
    )


def summary(entries: DataFrame) -> DataFrame:
    """Usable and rejected scans; points kept and read of the rendered ones."""
    out = entries.agg(
        F.count_if("rendered").alias("usable"),
        F.count_if(~F.col("rendered")).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("rendered"), F.col("loaded_points"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("rendered"), F.col("source_points"))), F.lit(0)).alias("source"),
    )
    return out.withColumns({"kept_shown": human_count(F.col("kept")), "source_shown": human_count(F.col("source"))})
