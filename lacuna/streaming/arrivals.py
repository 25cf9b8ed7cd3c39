"""Scan files as they arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.e2807 import read_binary

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_points(spark: SparkSession, folder: str, fields: list[str], files_per_trigger: int = 16) -> DataFrame:
    """Points of every file once, from any store that Spark reads; ``folder`` may grow while the stream runs."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.e57").load(folder)
    return read_binary(files, fields)


def running_stats(points: DataFrame) -> DataFrame:
    """Per file and scan the records so far and their extent (update or complete mode)."""
    return points.groupBy("path", "scan_index").agg(F.count("*").alias("decoded"), F.min("cartesianX").alias("min_x"), F.max("cartesianX").alias("max_x"))
