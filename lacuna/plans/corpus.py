"""A scan corpus derived from the relational tables, for queries and their SQL.

Five scans of shell geometry: three of one surface, two of three surfaces 3 m
apart. The SQL text runs unchanged in Spark and DuckDB; ``META_SQL`` is for
DuckDB only, the metadata of Spark's queries being built apart from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """
SELECT scan_id, record_idx, az, el, rng,
       rng * cos(el) * cos(az) AS x, rng * cos(el) * sin(az) AS y, rng * sin(el) AS z,
       invalid_state, intensity, red, green, blue, row_index, col_index
FROM (
  SELECT scan_id, record_idx, az, el,
         5e0 + 1.5e0 * cos(el) * cos(az) * cos(el) * sin(az) + CASE WHEN scan_id >= 3 THEN 3e0 * (ln % 3) ELSE 0e0 END AS rng,
         invalid_state, intensity, red, green, blue, row_index, col_index
  FROM (
    SELECT s_nationkey % 5 AS scan_id,
           CAST(row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS record_idx,
           ((l_partkey * 37 + l_orderkey) % 6283) / 1e3 - 3.1415e0 AS az,
           ((l_orderkey * 613 + l_partkey) % 3140) / 1e3 - 1.57e0 AS el,
           l_linenumber AS ln, CASE WHEN l_orderkey % 50 = 0 THEN 2 ELSE 0 END AS invalid_state,
           l_quantity AS intensity, l_discount * 2550e0 AS red, l_tax * 3000e0 AS green, l_quantity * 6e0 AS blue,
           CAST(l_linenumber AS BIGINT) AS row_index, l_partkey AS col_index
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
  ) raw
) shaped
"""

META_SQL = """
SELECT CAST(v.scan_id AS INT) AS scan_id, coalesce(r_name, '') AS name, has_pose, tx, ty, tz, has_spherical, rowcol_varies,
       row_min, row_max, col_min, col_max, has_grouping, bound, coalesce(n, 0) AS record_count
FROM (VALUES
  (0, true, 0e0, 0e0, 1.5e0, false, false, NULL, NULL, NULL, NULL, false, 13e0),
  (1, true, 40e0, 0e0, 1.5e0, false, false, 1, 7, 0, 1999, false, 13e0),
  (2, false, 0e0, 0e0, 0e0, false, false, NULL, NULL, NULL, NULL, false, 13e0),
  (3, true, 120e0, 0e0, 1.5e0, false, false, NULL, NULL, NULL, NULL, false, 6e0),
  (4, true, 160e0, 0e0, 1.5e0, false, false, NULL, NULL, NULL, NULL, true, 13e0)
) v(scan_id, has_pose, tx, ty, tz, has_spherical, rowcol_varies, row_min, row_max, col_min, col_max, has_grouping, bound)
LEFT JOIN region ON r_regionkey = v.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM points GROUP BY scan_id) c ON c.scan_id = v.scan_id
"""

#: Shift of each scan's points in the corpus that reaches every frame.
SHIFTS = {0: (0.0, 0.0, 0.0), 1: (40.0, 0.0, 1.5), 2: (100.0, 0.0, 0.0), 3: (20.0, 0.0, 0.0), 4: (160.0, 0.0, 1.5)}
GLOBAL_SQL = (
    "SELECT p.* REPLACE (x + sx AS x, y + sy AS y, z + sz AS z) FROM points p JOIN (VALUES "
    + ", ".join(f"({k}, {x!r}e0, {y!r}e0, {z!r}e0)" for k, (x, y, z) in SHIFTS.items())
    + ") s(scan_id, sx, sy, sz) ON p.scan_id = s.scan_id"
)


def oracle(select: str, *more: str) -> str:
    """DuckDB SQL over the views points, meta, gpoints and those of ``more`` (name AS (...))."""
    views = [f"points AS ({POINTS_SQL.format(lineitem='lineitem', supplier='supplier')})", f"meta AS ({META_SQL})", f"gpoints AS ({GLOBAL_SQL})", *more]
    return f"WITH RECURSIVE {', '.join(views)} {select}"


def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    return spark.sql(POINTS_SQL, lineitem=lineitem, supplier=supplier)


def scan_points_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = scan_points(spark, sf_dir)
    shift = F.create_map(*[x for k, v in SHIFTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("scan_id")]
    return points.withColumns({c: F.col(c) + F.get(shift, F.lit(i)) for i, c in enumerate("xyz")})


META = (
    "scan_id int, has_pose boolean, q array<double>, t array<double>, has_index_bounds boolean, row_min bigint, row_max bigint, col_min bigint, col_max bigint, has_point_grouping boolean, "
    "has_cartesian_bounds boolean, x_min double, x_max double, y_min double, y_max double, z_min double, z_max double, "
    "proto array<struct<name: string, type: string, minimum: bigint, maximum: bigint, scale: double, offset: double, bits: int>>"
)


def scan_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scan, in the schema of a file's scan catalogue."""
    plain = [(n, "Float", None, None, 1.0, 0.0, 64) for n in ("cartesianX", "cartesianY", "cartesianZ")]
    plain += [("cartesianInvalidState", "Integer", 0, 2, 1.0, 0.0, 2)]
    plain += [(n, "Float", None, None, 1.0, 0.0, 32) for n in ("intensity", "colorRed", "colorGreen", "colorBlue")]
    constant = [("rowIndex", "Integer", 7, 7, 1.0, 0.0, 0), ("columnIndex", "Integer", 3, 3, 1.0, 0.0, 0)]
    rows = []
    for k, t, grid, grouping, bound in ((0, (0.0, 0.0, 1.5), None, False, 13.0), (1, (40.0, 0.0, 1.5), (1, 7, 0, 1999), False, 13.0), (2, None, None, False, 13.0), (3, (120.0, 0.0, 1.5), None, False, 6.0), (4, (160.0, 0.0, 1.5), None, True, 13.0)):
        bounds = [x for _ in "xyz" for x in (-bound, bound)]
        rows.append((k, t is not None, [1.0, 0.0, 0.0, 0.0], list(t or (0.0, 0.0, 0.0)), grid is not None, *(grid or (None,) * 4), grouping, True, *bounds, plain + constant * (k == 0)))
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("scan_id"), F.col("r_name").alias("name"))
    counts = scan_points(spark, sf_dir).groupBy("scan_id").agg(F.count("*").alias("record_count"))
    meta = spark.createDataFrame(rows, META)
    return meta.join(F.broadcast(region), "scan_id", "left").join(F.broadcast(counts), "scan_id", "left").fillna({"name": "", "record_count": 0})
