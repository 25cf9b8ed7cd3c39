"""Queries over the scan-file format, with SQL where it can express them."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import bits_needed, to_logical, to_physical
from ..operators import audit, classify, cloud, load, rangeimage, session
from ..operators.graph import shared_dir
from ..sources import codec, e2807
from .corpus import oracle, scan_meta, scan_points
from .scan_queries import ORACLES as ORACLES_OF_SCANS
from .scan_queries import T3, rounded
from .space_queries import ORACLES as ORACLES_OF_SPACE
from .space_queries import T6, component_report

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query("SELECT doc_id, (n_chars // 1020) * 1024 + n_chars % 1020 AS physical, (((n_chars // 1020) * 1024 + n_chars % 1020) // 1024) * 1020 + ((n_chars // 1020) * 1024 + n_chars % 1020) % 1024 AS logical FROM documents")
def page_address_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", to_physical(F.col("n_chars")).alias("physical"))
    return docs.withColumn("logical", to_logical(F.col("physical")))


@query("SELECT p_partkey, CASE WHEN high <= low THEN 0 WHEN high - low > 9223372036854775807 THEN 64 ELSE length(bin(CAST(high - low AS BIGINT))) END AS bits FROM (SELECT p_partkey, CAST(CASE WHEN p_partkey % 97 = 0 THEN -9223372036854775808 ELSE p_size - p_partkey END AS HUGEINT) AS low, CAST(CASE WHEN p_partkey % 97 = 0 THEN 9223372036854775807 WHEN p_partkey % 89 = 0 THEN p_size - p_partkey ELSE p_size * p_partkey END AS HUGEINT) AS high FROM part)")
def bits_needed_(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    low = F.when(k % 97 == 0, F.lit(-(2**63))).otherwise(size - k)
    high = F.when(k % 97 == 0, F.lit(2**63 - 1)).when(k % 89 == 0, size - k).otherwise(size * k)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", low.alias("low"), high.alias("high")).select("p_partkey", bits_needed(F.col("low"), F.col("high")).alias("bits"))


for store in (QUERIES, ORACLES):
    store["bits_needed"] = store.pop("bits_needed_")

FIELDS = [
    codec.Field("cartesianX", "ScaledInteger", -(2**24), 2**24, 1e-4),
    codec.Field("cartesianY", "ScaledInteger", -(2**24), 2**24, 1e-4),
    codec.Field("cartesianZ", "Float"),
    codec.Field("cartesianInvalidState", "Integer", 0, 2),
    codec.Field("intensity", "Float", precision="single"),
]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, as a path that both the driver and the tasks open."""
    path = os.path.join(shared_dir(spark).removeprefix("file://"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def written(spark: SparkSession, sf_dir: str) -> str:
    """The corpus' points as scan files in the shared folder."""
    e2807.register(spark)
    path = folder(spark, "scans")
    raw = scan_points(spark, sf_dir).select(F.round(F.col("x") * 1e4).cast("long").alias("cartesianX"), F.round(F.col("y") * 1e4).cast("long").alias("cartesianY"), F.col("z").alias("cartesianZ"), F.col("invalid_state").cast("long").alias("cartesianInvalidState"), F.col("intensity"))
    raw.write.format("e2807").option("prototype", e2807.proto_json(FIELDS)).mode("append").save(path)
    return path


@query(oracle("SELECT count(*) AS records, count(*) FILTER (WHERE invalid_state <> 0) AS invalid, round(sum(round(x * 1e4) * 1e-4), 3) AS sum_x, round(sum(round(y * 1e4) * 1e-4), 3) AS sum_y, round(sum(z), 3) AS sum_z FROM points"))
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and sums after writing the points to scan files and reading them back."""
    path = written(spark, sf_dir)
    points = spark.read.format("e2807").option("fields", "cartesianX,cartesianY,cartesianZ,cartesianInvalidState").load(path)
    return points.agg(F.count("*").alias("records"), F.count_if(F.col("cartesianInvalidState") != 0).alias("invalid"), *[F.round(F.sum(f"cartesian{c}"), 3).alias(f"sum_{c.lower()}") for c in "XYZ"])


CASES = 5_000


def cases(spark: SparkSession) -> str:
    """A folder of small files: with restarts, cut short, with two damaged pages, and no scan file at all."""
    e2807.register(spark)
    base = folder(spark, "cases")
    fields = [codec.Field("cartesianX", "Integer", 0, 2047), codec.Field("cartesianY")]
    values = [np.arange(CASES) % 2048, np.arange(CASES) / 7]
    whole = codec.write([(codec.Scan(fields, CASES, 0), values)], 64, restart_every=3)
    damaged = bytearray(whole)
    damaged[2 * codec.PAGE + 100] ^= 1
    damaged[5 * codec.PAGE + 7] ^= 64
    short = codec.write([(codec.Scan(fields, CASES, 0), [v[: CASES // 2] for v in values])], 64)
    for name, data in (("restarts", whole), ("short", short), ("damaged", bytes(damaged)), ("other", b"no scan file" * 200)):
        with open(os.path.join(base, f"{name}.e57"), "wb") as f:
            f.write(data)
    return base


@query("SELECT 'damaged' AS file, CAST(2 AS BIGINT) AS bad_pages, CAST(2 AS BIGINT) AS first_bad UNION ALL SELECT unnest(['restarts', 'written']), 0, -1")
def crc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose checksum is wrong: of all files written, of a good one, and of one with two damaged pages."""
    base = cases(spark)
    pages = lambda path, name: spark.read.format("e2807").option("mode", "pages").load(path).withColumn("file", F.lit(name))
    found = pages(written(spark, sf_dir), "written").unionByName(pages(f"{base}/restarts.e57", "restarts")).unionByName(pages(f"{base}/damaged.e57", "damaged"))
    return found.groupBy("file").agg(F.count_if(F.col("stored") != F.col("computed")).alias("bad_pages"), F.coalesce(F.min(F.when(F.col("stored") != F.col("computed"), F.col("page_no"))), F.lit(-1)).alias("first_bad"))


@query(f"SELECT 'restarts' AS \"case\", count(*) AS records, round(sum(i / 7e0), 3) AS sum_y FROM range({CASES}) r(i) UNION ALL SELECT 'limit', 10, round(sum(i / 7e0), 3) FROM range(10) r(i) UNION ALL SELECT 'short', 0, 0e0")
def decode_restart_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read of a file with restarts, of its first ten by a limit, and of one that was cut short."""
    base = cases(spark)
    read = lambda name: spark.read.format("e2807").options(fields="cartesianX,cartesianY", on_error="PERMISSIVE").load(f"{base}/{name}.e57")
    counted = lambda name, df: df.agg(F.count("*").alias("records"), F.round(F.coalesce(F.sum("cartesianY"), F.lit(0.0)), 3).alias("sum_y")).withColumn("case", F.lit(name))
    return counted("restarts", read("restarts")).unionByName(counted("limit", read("restarts").limit(10))).unionByName(counted("short", read("short")))


@query(f"SELECT unnest(['restarts', 'short']) AS file, 0 AS scan_index, CAST({CASES} AS BIGINT) AS records, unnest([CAST({CASES} AS BIGINT), {CASES // 2}]) AS decoded, unnest(['', 'decoded {CASES // 2} of {CASES} records']) AS error UNION ALL SELECT 'other', -1, -1, -1, 'bad signature: not a scan file'")
def scan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with files that are cut short or no scan files."""
    found = spark.read.format("e2807").option("mode", "audit").load(cases(spark)).withColumn("file", F.regexp_extract("path", r"(\w+)\.e57$", 1)).where("file <> 'damaged'")
    return found.fillna(-1).fillna("").select("file", "scan_index", "records", "decoded", "error")


@query(ORACLES_OF_SPACE["component_report"])
def export_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component report written as CSV and read back."""
    path = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    report = component_report(spark, sf_dir)
    report.write.option("header", True).csv(path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


# ---- the corpus as files, and each operator on them -------------------------
def session_paths(spark: SparkSession, sf_dir: str, spherical: bool = False) -> list[str]:
    """The corpus as one file per scan, in two folders, with the catalogue that its metadata describes."""
    e2807.register(spark)
    positions = load.SPHERICAL if spherical else load.CARTESIAN
    fields = [codec.Field(n) for n in positions] + [codec.Field("sphericalInvalidState" if spherical else "cartesianInvalidState", "Integer", 0, 2)]
    fields += [codec.Field(n) for n in ("intensity", "colorRed", "colorGreen", "colorBlue")]
    constant = [codec.Field("rowIndex", "Integer", 7, 7), codec.Field("columnIndex", "Integer", 3, 3)]
    headers = {}
    for m in scan_meta(spark, sf_dir).collect():
        own = {"name": m["name"], "guid": f"scan-{m['scan_id']}", "fields": [vars(f) for f in fields + constant * (m["scan_id"] == 0)], "grouping": m["has_point_grouping"]}
        own |= {"has_pose": True, "q": m["q"], "t": m["t"]} if m["has_pose"] else {}
        own |= {"index_bounds": [m["row_min"], m["row_max"], m["col_min"], m["col_max"]]} if m["has_index_bounds"] else {}
        headers[m["scan_id"]] = own | {"bounds": [m[f"{c}_{e}"] for c in "xyz" for e in ("min", "max")]}
    source = dict(zip(positions, ("rng", "az", "el") if spherical else "xyz")) | {"intensity": "intensity", "colorRed": "red", "colorGreen": "green", "colorBlue": "blue"}
    points = scan_points(spark, sf_dir).select("scan_id", "record_idx", F.col("invalid_state").cast("long").alias(fields[3].name), *[F.col(c).alias(n) for n, c in source.items()], F.lit(7).cast("long").alias("rowIndex"), F.lit(3).cast("long").alias("columnIndex"))
    paths = []
    for name, part in (("first", "scan_id < 3"), ("second", "scan_id >= 3")):
        paths.append(folder(spark, name))
        rows = points.where(part).repartition("scan_id").sortWithinPartitions("scan_id", "record_idx").drop("record_idx")
        rows.write.format("e2807").option("key", "scan_id").option("scans", json.dumps(headers)).mode("append").save(paths[-1])
    return paths


def of_files(name: str, sql: str, spherical: bool = False):
    """Registers a query on (catalogue, points) of the corpus' files, the two folders opened one after the other."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            first, second = session_paths(spark, sf_dir, spherical)
            return fn(*load.append(load.session(spark, [first], "FAILFAST"), load.session(spark, [second], "FAILFAST")))

        run.__name__ = name
        QUERIES[name], ORACLES[name] = run, sql
        return fn

    return add


@of_files("file_catalogue", oracle("SELECT scan_id, name, 'scan-' || scan_id AS guid, has_pose, record_count, coalesce(row_min, -1) AS row_min, coalesce(row_max, -1) AS row_max, coalesce(col_min, -1) AS col_min, coalesce(col_max, -1) AS col_max, has_grouping AS has_point_grouping, -bound AS x_min, bound AS z_max, CASE WHEN scan_id = 0 THEN 10 ELSE 8 END AS n_fields FROM meta"))
def file_catalogue(scans: DataFrame, points: DataFrame) -> DataFrame:
    return scans.fillna(-1, ["row_min", "row_max", "col_min", "col_max"]).select("scan_id", "name", "guid", "has_pose", "record_count", "row_min", "row_max", "col_min", "col_max", "has_point_grouping", "x_min", "z_max", F.size("proto").alias("n_fields"))


@of_files("file_points", oracle("SELECT scan_id, record_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, invalid_state, intensity, red, green, blue FROM points"))
def file_points(scans: DataFrame, points: DataFrame) -> DataFrame:
    return rounded(points, 6, "x", "y", "z").select("scan_id", "record_idx", "x", "y", "z", "invalid_state", "intensity", "red", "green", "blue")


@of_files("file_spherical_points", ORACLES_OF_SCANS["spherical_to_cartesian"], spherical=True)
def file_spherical_points(scans: DataFrame, points: DataFrame) -> DataFrame:
    return rounded(points, 6, "x", "y", "z").select("scan_id", "record_idx", "x", "y", "z")


@of_files("file_blocks", oracle("SELECT scan_id, count(*) AS n, CAST(count(*) FILTER (WHERE invalid_state <> 0) AS BIGINT) AS invalid, round(max(sqrt(x * x + y * y + z * z)), 6) AS reach FROM points GROUP BY scan_id"))
def file_blocks(scans: DataFrame, points: DataFrame) -> DataFrame:
    """User code that sums up each block of points."""

    def reach(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        scan, x, y, z, invalid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        own, place = np.unique(scan, return_inverse=True)
        most = np.zeros(len(own))
        np.maximum.at(most, place, np.sqrt(x * x + y * y + z * z))
        return pa.record_batch([pa.array(own), pa.array(np.bincount(place)), pa.array(np.bincount(place, invalid != 0).astype(np.int64)), pa.array(most)], names=["scan_id", "n", "invalid", "reach"])

    sums = load.blocks(points.select("scan_id", "x", "y", "z", "invalid_state"), reach, "scan_id int, n bigint, invalid bigint, reach double")
    return sums.groupBy("scan_id").agg(F.sum("n").alias("n"), F.sum("invalid").alias("invalid"), F.round(F.max("reach"), 6).alias("reach"))


@of_files("file_audit", ORACLES_OF_SCANS["audit_report"])
def file_audit(scans: DataFrame, points: DataFrame) -> DataFrame:
    return rounded(audit.audit(points, scans), 2, "pct")


@of_files("file_classify", ORACLES_OF_SCANS["classify"])
def file_classify(scans: DataFrame, points: DataFrame) -> DataFrame:
    return classify.classify(points, scans, T3).select("scan_id", "kind", F.round("fraction", 6).alias("fraction"), "bins_tested", "points_sampled")


@of_files("file_metadata", ORACLES_OF_SCANS["classify_metadata"])
def file_metadata(scans: DataFrame, points: DataFrame) -> DataFrame:
    return classify.classify_metadata(scans).withColumn("evidence", F.array_join("evidence", "\n"))


@of_files("file_clouds", ORACLES_OF_SCANS["cloud_offsets"])
def file_clouds(scans: DataFrame, points: DataFrame) -> DataFrame:
    return rounded(cloud.load_clouds(points, scans)[1].select("scan_id", "record_idx", "dx", "dy", "dz"), 4, "dx", "dy", "dz")


@of_files("file_session", ORACLES_OF_SPACE["session_report"])
def file_session(scans: DataFrame, points: DataFrame) -> DataFrame:
    return session.report(points, scans, T3).drop("summary", "detail")


@of_files("file_range_images", ORACLES_OF_SPACE["range_image_min"])
def file_range_images(scans: DataFrame, points: DataFrame) -> DataFrame:
    return rangeimage.range_bins(points, T6)
