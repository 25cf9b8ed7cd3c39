"""Lineage cutting and connected components, both distributed."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, else, where all runs in one process, a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Tables:
    """Tables that a computation writes into the shared folder for itself.

    A table is computed once (a checkpoint computes its last stage a second
    time), and can be read again after an executor is lost. What is returned to
    a caller has to be cut before the tables are removed.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of an edge (longs u and v) reaches.

    Large-star and small-star rounds alternate until nothing changes, so that
    their number grows with the logarithm of a component's size.
    """
    tables = Tables(edges.sparkSession)
    known = tables.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        new = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (new["n"], new["h"]) == mark:
            found = cut(known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            tables.remove()
            return found
        mark = new["n"], new["h"]
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        known = tables.keep(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
