"""Queries over views, range images, carving and voids, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carve, pick, rangeimage, session, voids
from ..operators.camera import OrbitCamera, inverse
from ..operators.graph import shared_dir
from ..params import Grid, LoadOptions, Thresholds
from .corpus import oracle, scan_meta, scan_points
from .scan_queries import BINS, T3

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# ---- views -----------------------------------------------------------------
def camera() -> OrbitCamera:
    out = OrbitCamera()
    out.set_viewport(1200, 800)
    out.frame((-8, -8, -6), (8, 8, 6))
    out.orbit(120, -40)
    return out


def lit(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def sql_row(m: np.ndarray, row: int, v=("x", "y", "z")) -> str:
    return " + ".join(f"{c} * ({lit(a)})" for a, c in zip(m[row].tolist(), v)) + f" + ({lit(m[row, 3])})"


M = camera().matrix()
CLIP = "clip AS (SELECT scan_id, record_idx, x, y, z, " + ", ".join(f"{sql_row(M, i)} AS c{c}" for i, c in enumerate("xyzw")) + " FROM points WHERE invalid_state = 0)"


def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_points(spark, sf_dir).where("invalid_state = 0").select("scan_id", "record_idx", "x", "y", "z")


@query(oracle("SELECT scan_id, record_idx, round(cw, 4) AS clip_w, round(cx / cw, 4) AS ndc_x, round(cy / cw, 4) AS ndc_y FROM clip WHERE cw > 1e-6", CLIP))
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pick.project(valid_points(spark, sf_dir), M).where("ndc_x IS NOT NULL")
    return rounded(seen, 4, "clip_w", "ndc_x", "ndc_y").select("scan_id", "record_idx", "clip_w", "ndc_x", "ndc_y")


@query(oracle(f"SELECT scan_id, record_idx, round(cw, 4) AS depth, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM clip WHERE cw > 1e-6 AND ((cx / cw - 0.1e0) / ({lit(2 * 24 / 1200)})) ** 2 + ((cy / cw + 0.05e0) / ({lit(2 * 24 / 800)})) ** 2 <= 1 ORDER BY cw, scan_id, record_idx LIMIT 1", CLIP))
def pick_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pick.pick_nearest(valid_points(spark, sf_dir), camera(), 0.1, -0.05, 24)
    return rounded(found.withColumnRenamed("clip_w", "depth"), 4, "depth", "x", "y", "z").select("scan_id", "record_idx", "depth", "x", "y", "z")


READINGS = "SELECT s_suppkey, (s_suppkey % 21 - 10) / 10e0 AS x, (s_suppkey % 13 - 6) / 6e0 AS y, CASE WHEN s_suppkey % 7 = 0 THEN 1e0 ELSE 0.99e0 + (s_suppkey % 97) / 1e4 END AS z FROM supplier"
BACK = inverse(M)


@query(f"SELECT s_suppkey, z < {lit(float(np.float32(0.999999)))} AS hit, " + ", ".join(f"CASE WHEN z < {lit(float(np.float32(0.999999)))} THEN round(({sql_row(BACK, i)}) / ({sql_row(BACK, 3)}), 3) END AS w{c}" for i, c in enumerate("xyz")) + f" FROM ({READINGS})")
def unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    readings = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey", ((s % 21 - 10) / 10.0).alias("ndc_x"), ((s % 13 - 6) / 6.0).alias("ndc_y"), F.when(s % 7 == 0, 1.0).otherwise(0.99 + (s % 97) / 1e4).alias("depth")
    )
    return rounded(pick.unproject(readings, M), 3, "wx", "wy", "wz").select("s_suppkey", "hit", "wx", "wy", "wz")


TINT_SQL = "[" + ", ".join(f"'{r},{g},{b}'" for r, g, b in pick.TINTS) + "]"


@query(oracle(f"SELECT scan_id, record_idx, round(least(24e0, greatest(1e0, 60e0 / greatest(cw, 1e-4))), 4) AS sprite, {TINT_SQL}[scan_id % 8 + 1] AS tint FROM clip WHERE cw > 1e-6", CLIP))
def point_sprite(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pick.project(valid_points(spark, sf_dir), M).where("ndc_x IS NOT NULL")
    drawn = pick.sprites(seen, 3.0, 20.0).withColumn("tint", F.array_join(F.transform("tint", lambda v: v.cast("string")), ","))
    return rounded(drawn, 4, "sprite").select("scan_id", "record_idx", "sprite", "tint")


# ---- session ---------------------------------------------------------------
REPORT = """verdicts AS (SELECT m.*, CASE WHEN share > 0.2e0 THEN 'unified/merged' WHEN share >= 0 OR coalesce(row_max > row_min AND col_max > col_min, false) OR has_grouping THEN 'structured' ELSE 'ambiguous' END AS kind
  FROM meta m LEFT JOIN (SELECT scan_id, CASE WHEN tested >= 200 THEN multi / tested ELSE -1e0 END AS share FROM (
    SELECT scan_id, count(*) FILTER (WHERE n >= 4) AS tested, count(*) FILTER (WHERE n >= 4 AND hi - lo > CAST(0.5 AS FLOAT)) AS multi FROM bins GROUP BY scan_id)) t ON m.scan_id = t.scan_id),
report AS (SELECT v.scan_id, CASE WHEN name = '' THEN 'scan ' || v.scan_id ELSE name END AS name, kind, record_count AS source_points,
  CASE WHEN kind = 'structured' THEN coalesce(n, 0) ELSE 0 END AS loaded_points, kind = 'structured' AND coalesce(n, 0) > 0 AS rendered
  FROM verdicts v LEFT JOIN (SELECT p.scan_id, count(*) AS n FROM points p JOIN meta m ON m.scan_id = p.scan_id WHERE record_idx % greatest(1, (record_count + 3999999) // 4000000) = 0 AND invalid_state = 0 GROUP BY p.scan_id) k ON k.scan_id = v.scan_id)"""


@query(oracle("SELECT * FROM report", BINS, REPORT))
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.report(scan_points(spark, sf_dir), scan_meta(spark, sf_dir), T3, LoadOptions()).drop("summary", "detail")


SHOWN = "CASE WHEN {0} >= 1000000 THEN printf('%.1f M', {0} / 1e6) WHEN {0} >= 1000 THEN printf('%.1f k', {0} / 1e3) ELSE CAST({0} AS VARCHAR) END"


@query(oracle(f"SELECT *, {SHOWN.format('kept')} AS kept_shown, {SHOWN.format('source')} AS source_shown FROM (SELECT count(*) FILTER (WHERE rendered) AS usable, count(*) FILTER (WHERE NOT rendered) AS rejected, CAST(coalesce(sum(loaded_points) FILTER (WHERE rendered), 0) AS BIGINT) AS kept, CAST(coalesce(sum(source_points) FILTER (WHERE rendered), 0) AS BIGINT) AS source FROM report)", BINS, REPORT))
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.summary(session.report(scan_points(spark, sf_dir), scan_meta(spark, sf_dir), T3, LoadOptions()))


# ---- range images ----------------------------------------------------------
T6 = Thresholds(bin_degrees=6.0)
W6 = "6e0 * 3.14159265358979e0 / 180e0"
LOCAL = f"""local AS (SELECT scan_id, invalid_state, rr, CAST(least(59, greatest(0, floor((atan2(y, x) + 3.14159265358979e0) / ({W6})))) AS INT) AS ia, CAST(least(29, greatest(0, floor(acos(greatest(-1e0, least(1e0, z / rr))) / ({W6})))) AS INT) AS ie
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS rr FROM points) WHERE rr >= 1e-6)"""
IMAGE = "image AS (SELECT scan_id, ia, ie, CAST(least(65535, floor(min(rr) * 100e0 + 0.5e0)) AS INT) AS range_cm FROM local WHERE invalid_state = 0 GROUP BY ALL)"
GAPS = "gaps AS (SELECT scan_id, ia, nxt, nxt - ia AS gap FROM (SELECT scan_id, ia, coalesce(lead(ia) OVER (PARTITION BY scan_id ORDER BY ia), min(ia) OVER (PARTITION BY scan_id) + 60) AS nxt FROM (SELECT DISTINCT scan_id, ia FROM image)))"
FOV = "fov AS (SELECT h.scan_id, ie_from, ie_to, CASE WHEN gap < 2 THEN 0 ELSE nxt % 60 END AS ia_from, CASE WHEN gap < 2 THEN 60 ELSE 60 - gap + 1 END AS ia_extent FROM (SELECT scan_id, min(ie) AS ie_from, max(ie) AS ie_to FROM image GROUP BY scan_id) h JOIN (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY gap DESC, ia) AS r FROM gaps) g ON g.scan_id = h.scan_id AND r = 1)"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeimage.range_bins(scan_points(spark, sf_dir), T6)


@query(oracle("SELECT * FROM image", LOCAL, IMAGE))
def range_image_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir)


@query(oracle("SELECT scan_id, ia, gap FROM gaps", LOCAL, IMAGE, GAPS))
def azimuth_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeimage.azimuth_gaps(image(spark, sf_dir), T6.n_az).select("scan_id", "ia", "gap")


@query(oracle("SELECT * FROM fov", LOCAL, IMAGE, GAPS, FOV))
def scan_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeimage.field_of_view(image(spark, sf_dir), T6.n_az)


#: Scan 2 counts as one that stores no no-returns.
LOST = "lost AS (SELECT DISTINCT scan_id, ia, ie FROM local WHERE invalid_state <> 0 AND scan_id <> 2)"
STATUS = """status AS (
  SELECT f.scan_id, g.ia, g.ie, t.range_cm, CASE WHEN t.range_cm IS NOT NULL THEN 'HIT' WHEN CASE WHEN f.scan_id IN (SELECT scan_id FROM lost) THEN l.ia IS NOT NULL
    ELSE g.ie BETWEEN ie_from AND ie_to AND (g.ia - ia_from + 60) % 60 < ia_extent END THEN 'NO_RETURN' ELSE 'OUTSIDE_FOV' END AS status
  FROM fov f, (SELECT a.i AS ia, b.i AS ie FROM range(60) a(i), range(30) b(i)) g LEFT JOIN image t ON (t.scan_id, t.ia, t.ie) = (f.scan_id, g.ia, g.ie) LEFT JOIN lost l ON (l.scan_id, l.ia, l.ie) = (f.scan_id, g.ia, g.ie))"""
TO_STATUS = (LOCAL, IMAGE, GAPS, FOV, LOST, STATUS)


@query(oracle("SELECT scan_id, status, count(*) AS n FROM status GROUP BY ALL", *TO_STATUS))
def range_image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeimage.status_image(scan_points(spark, sf_dir), T6, F.col("scan_id") != 2).groupBy("scan_id", "status").agg(F.count("*").alias("n"))


@query(oracle("SELECT level, scan_id, ia, ie, lo, hi FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, scan_id, ia >> {k} AS ia, ie >> {k} AS ie, min(range_cm) AS lo, max(range_cm) AS hi FROM image GROUP BY ALL" for k in (1, 2, 3)) + ")", LOCAL, IMAGE))
def range_mip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeimage.mip(image(spark, sf_dir), 3)


# ---- carving: three setups 4 m apart, voxels of 1 m ------------------------
GRID = Grid(voxel=1.0, max_range=9.0, max_void_depth=3.0, min_void_volume=2.0)
LOW, HIGH = (-10, -10, -10), (18, 10, 10)
SETUPS = "setups AS (SELECT i AS scan_id, 4e0 * i AS sx FROM range(3) s(i))"
VOX = f"vox AS (SELECT CAST(a.v AS INT) AS i, CAST(b.v AS INT) AS j, CAST(c.v AS INT) AS k FROM range({LOW[0]}, {HIGH[0]}) a(v), range({LOW[1]}, {HIGH[1]}) b(v), range({LOW[2]}, {HIGH[2]}) c(v))"
OCC = "occ AS (SELECT DISTINCT CAST(floor(x + sx) AS INT) AS i, CAST(floor(y) AS INT) AS j, CAST(floor(z) AS INT) AS k FROM points p JOIN setups s ON s.scan_id = p.scan_id WHERE invalid_state = 0 AND sqrt(x * x + y * y + z * z) <= 9)"
SEEN = f"""seen AS (SELECT v.i, v.j, v.k, v.scan_id, rr, degrees(acos(least(1e0, abs(lz) / rr))) AS angle FROM (
  SELECT *, CAST(least(59, greatest(0, floor((atan2(ly, lx) + 3.14159265358979e0) / ({W6})))) AS INT) AS ia, CAST(least(29, greatest(0, floor(acos(greatest(-1e0, least(1e0, lz / rr))) / ({W6})))) AS INT) AS ie
  FROM (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS rr FROM (SELECT vox.*, scan_id, i + 0.5e0 - sx AS lx, j + 0.5e0 AS ly, k + 0.5e0 AS lz FROM vox, setups)) WHERE rr BETWEEN 1e-6 AND 9) v
  JOIN status m ON m.scan_id = v.scan_id AND m.ia = v.ia AND m.ie = v.ie WHERE status <> 'OUTSIDE_FOV' AND rr < coalesce(least(9e0, range_cm / 100e0 - {lit(GRID.surface_margin)}), 9e0))"""
VIS = "vis AS (SELECT DISTINCT i, j, k FROM seen)"
SPACE = (*TO_STATUS, SETUPS, VOX, OCC, SEEN, VIS)


def room(spark: SparkSession, sf_dir: str):
    """(voxels, setups, points with their world place, range image: centimetres of hits, null of directions without a return)."""
    setups = spark.range(3).select(F.col("id").cast("int").alias("scan_id"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("q"), F.array(F.col("id") * 4.0, F.lit(0.0), F.lit(0.0)).alias("t"))
    points = scan_points(spark, sf_dir).where("scan_id < 3").withColumns({"gx": F.col("x") + 4.0 * F.col("scan_id"), "gy": F.col("y"), "gz": F.col("z")})
    status = rangeimage.status_image(points, T6, F.col("scan_id") != 2)
    return carve.universe(spark, LOW, HIGH), setups, points, status.where(F.col("status") != rangeimage.OUTSIDE).select("scan_id", "ia", "ie", "range_cm")


def seen_space(spark: SparkSession, sf_dir: str):
    voxels, setups, points, img = room(spark, sf_dir)
    return voxels, carve.visible(voxels, setups, img, GRID, T6), carve.occupied(points, GRID)


@query(oracle("SELECT * FROM occ", *SPACE))
def occupied_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve.occupied(room(spark, sf_dir)[2], GRID)


@query(oracle("SELECT * FROM vis", *SPACE))
def visible_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_space(spark, sf_dir)[1]


@query(oracle("SELECT * FROM vox EXCEPT SELECT * FROM vis EXCEPT SELECT * FROM occ", *SPACE))
def unknown_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve.unknown(*seen_space(spark, sf_dir))


QUALITY = "SELECT i, j, k, count(*) AS n, round(min(angle), 3) AS best_angle, round(min(rr), 4) AS nearest FROM seen GROUP BY i, j, k"


@query(oracle(QUALITY, *SPACE))
def voxel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels, setups, _, img = room(spark, sf_dir)
    return rounded(rounded(carve.quality(voxels, setups, img, GRID, T6), 3, "best_angle"), 4, "nearest")


@query(oracle(f"SELECT i, j, k FROM ({QUALITY}) WHERE n = 1", *SPACE))
def single_setup_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels, setups, _, img = room(spark, sf_dir)
    return carve.quality(voxels, setups, img, GRID, T6).where("n = 1").select("i", "j", "k")


@query(oracle("SELECT i >> 3 AS bi, j >> 3 AS bj, k >> 3 AS bk, " + ", ".join(f"coalesce(bit_or(CASE WHEN k & 7 = {w} THEN CASE WHEN (i & 7) + 8 * (j & 7) = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST((i & 7) + 8 * (j & 7) AS BIGINT) END END), 0) AS w{w}" for w in range(8)) + " FROM occ GROUP BY 1, 2, 3", *SPACE))
def brick_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carve.pack_bricks(carve.occupied(room(spark, sf_dir)[2], GRID))


@query(oracle("SELECT * FROM occ", *SPACE))
def grid_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied space written as a table of bricks, and read back."""
    path = f"{shared_dir(spark)}/bricks-{uuid.uuid4().hex}"
    bricks = carve.pack_bricks(carve.occupied(room(spark, sf_dir)[2], GRID))
    bricks.write.parquet(path)
    return carve.unpack_bricks(spark.read.schema(bricks.schema).parquet(path))


@query(oracle("SELECT * FROM image WHERE scan_id IN (1, 3)", LOCAL, IMAGE))
def range_image_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range images written by scan, and two of them read back."""
    path = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"
    rangeimage.write_cache(image(spark, sf_dir), path)
    return rangeimage.read_cache(spark, path).where("scan_id IN (1, 3)")


# ---- voids -----------------------------------------------------------------
MOVES = "moves(di, dj, dk) AS (VALUES " + ", ".join(map(str, voids.STEPS)) + ")"
FREE = "free AS (SELECT * FROM vox EXCEPT SELECT * FROM vis EXCEPT SELECT * FROM occ)"
FRONT = "front AS (SELECT i, j, k, 0 AS d FROM vis UNION SELECT n.i, n.j, n.k, f.d + 1 FROM front f, moves, free n WHERE f.d < 3 AND n.i = f.i + di AND n.j = f.j + dj AND n.k = f.k + dk)"
VOIDS = "voids AS (SELECT DISTINCT i, j, k FROM front WHERE d > 0)"
KEYED = "keyed AS (SELECT *, ((i + 1048576) * CAST(4398046511104 AS BIGINT)) + (j + 1048576) * CAST(2097152 AS BIGINT) + k + 1048576 AS node FROM voids)"
#: One label a voxel, which falls until no neighbour has a smaller one.
REACH = "reach(node, label) USING KEY (node) AS (SELECT node, node FROM keyed UNION SELECT b.node, min(r.label) FROM reach r JOIN keyed a ON a.node = r.node, moves, keyed b JOIN recurring.reach old ON old.node = b.node WHERE b.i = a.i + di AND b.j = a.j + dj AND b.k = a.k + dk AND r.label < old.label GROUP BY b.node)"
COMP = "comp AS (SELECT i, j, k, label AS comp FROM keyed JOIN reach USING (node))"
TO_VOIDS = (*SPACE, MOVES, FREE, FRONT, VOIDS)
TO_COMP = (*TO_VOIDS, KEYED, REACH, COMP)


def void_space(spark: SparkSession, sf_dir: str):
    """(voids, observed space); observed and occupied space are cut, since every round reads them."""
    voxels, seen, full = seen_space(spark, sf_dir)
    seen, full = voids.cut(seen), voids.cut(full)
    return voids.dilate(seen, full, voxels, GRID.void_steps), seen


@query(oracle("SELECT * FROM voids", *TO_VOIDS))
def void_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return void_space(spark, sf_dir)[0]


@query(oracle("SELECT comp, count(*) AS voxels FROM comp GROUP BY comp", *TO_COMP))
def void_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids.components(void_space(spark, sf_dir)[0]).groupBy("comp").agg(F.count("*").alias("voxels"))


SIDES = [f"{n}_{c}" for n in ("lo", "hi") for c in "xyz"]
REPORT_SQL = (
    "SELECT comp, voxels, CAST(voxels AS DOUBLE) AS volume, faces, "
    + ", ".join([f"round(c{c}, 4) AS c{c}" for c in "xyz"] + SIDES)
    + ", CASE WHEN faces > 0 AND voxels <= 60 THEN 'SHADOW' WHEN voxels >= 200 AND sqrt(faces) BETWEEN 0.8 AND 2.1 THEN 'UNVISITED' ELSE 'REVIEW' END AS class FROM ("
    + "SELECT s.*, coalesce(faces, 0) AS faces FROM (SELECT comp, count(*) AS voxels, "
    + ", ".join([f"avg({n}) + 0.5e0 AS c{c}" for n, c in zip("ijk", "xyz")] + [f"CAST(min({n}) AS DOUBLE) AS lo_{c}" for n, c in zip("ijk", "xyz")] + [f"CAST(max({n}) + 1 AS DOUBLE) AS hi_{c}" for n, c in zip("ijk", "xyz")])
    + " FROM comp GROUP BY comp) s LEFT JOIN (SELECT comp, count(*) AS faces FROM comp c, moves, vis v WHERE v.i = c.i + di AND v.j = c.j + dj AND v.k = c.k + dk GROUP BY comp) f ON f.comp = s.comp) WHERE voxels >= 2"
)


@query(oracle(REPORT_SQL, *TO_COMP))
def component_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = void_space(spark, sf_dir)
    out = voids.report(voids.components(found), seen, GRID, 60.0, 200.0)
    return rounded(rounded(out, 4, "cx", "cy", "cz"), 6, "volume", *SIDES)


@query(oracle("SELECT level, n, n > coalesce(CASE WHEN lag(level) OVER w = level - 1 THEN lag(n) OVER w END, 0) AND n > coalesce(CASE WHEN lead(level) OVER w = level + 1 THEN lead(n) OVER w END, 0) AS peak FROM (SELECT CAST(floor(z / 0.5e0) AS INT) AS level, count(*) AS n FROM points WHERE invalid_state = 0 GROUP BY 1) WINDOW w AS (ORDER BY level)"))
def storey_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids.storeys(valid_points(spark, sf_dir), 0.5)


PLAN = (
    "around(di, dj) AS (VALUES " + ", ".join(map(str, voids.AROUND)) + ")",
    "grown AS (SELECT DISTINCT i + di AS i, j + dj AS j FROM (SELECT DISTINCT i, j FROM vis), around)",
    "closed AS (SELECT i + di AS i, j + dj AS j FROM grown, around GROUP BY 1, 2 HAVING count(*) = 9)",
    "frame AS (SELECT a.v AS i, b.v AS j FROM range((SELECT min(i) - 1 FROM closed), (SELECT max(i) + 2 FROM closed)) a(v), range((SELECT min(j) - 1 FROM closed), (SELECT max(j) + 2 FROM closed)) b(v))",
    "blank AS (SELECT i, j FROM frame EXCEPT SELECT i, j FROM closed)",
    "outside AS (SELECT min(i) AS i, min(j) AS j FROM frame UNION SELECT b.i, b.j FROM outside o, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(di, dj), blank b WHERE b.i = o.i + di AND b.j = o.j + dj)",
    "filled AS (SELECT i, j FROM frame EXCEPT SELECT i, j FROM outside)",
    "plan AS (SELECT DISTINCT i + di AS i, j + dj AS j FROM filled, around)",
)


@query(oracle("SELECT i, j, k FROM voids SEMI JOIN plan USING (i, j)", *TO_VOIDS, *PLAN))
def footprint_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, seen = void_space(spark, sf_dir)
    return voids.clip(found, voids.footprint(seen))


@query(oracle("SELECT * FROM voids WHERE i BETWEEN -3 AND 10 AND j BETWEEN -4 AND 3 AND k BETWEEN -2 AND 5", *TO_VOIDS))
def envelope_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids.within_envelope(void_space(spark, sf_dir)[0], carve.universe(spark, (-3, -4, -2), (11, 4, 6)))


@query(oracle("SELECT CASE WHEN NOT has_pose THEN 'unknown' WHEN tx BETWEEN -10 AND 130 AND ty BETWEEN -10 AND 10 AND tz BETWEEN 0 AND 3 THEN 'inside' ELSE 'outside' END AS place, count(*) AS setups, CAST(sum(record_count) AS BIGINT) AS points FROM meta GROUP BY 1"))
def setup_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voids.setup_distribution(scan_meta(spark, sf_dir), (-10.0, -10.0, 0.0), (130.0, 10.0, 3.0))
