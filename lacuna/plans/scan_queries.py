"""Queries over the scan corpus: classification, audit and clouds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import spherical_to_cartesian
from ..functions.text import human_count
from ..operators import audit, classify, cloud
from ..params import LoadOptions, Thresholds
from .corpus import oracle, scan_meta, scan_points, scan_points_global

#: At the default of 1 degree no scan of this corpus has enough full bins.
T3 = Thresholds(bin_degrees=3.0)
SMALL = Thresholds(bin_degrees=3.0, sample_target=2_000)
#: Of ``decimate`` alone: small enough that it has something to leave out.
BUDGET = LoadOptions(max_points=3_000)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


R6 = lambda *cols: ", ".join(f"round({c}, 6) AS {a}" for c, a in cols)
STEP = "greatest(1, m.record_count // {0})"
KEEP = "SELECT p.* FROM points p JOIN meta m ON p.scan_id = m.scan_id WHERE record_idx % greatest(1, (m.record_count + {0} - 1) // {0}) = 0 AND invalid_state = 0"
FEW = f"kept AS ({KEEP.format(BUDGET.max_points)})"
KEPT = f"kept AS ({KEEP.format(LoadOptions().max_points)})"
HEADS = "heads AS (SELECT scan_id, x AS ox, y AS oy, z AS oz FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY record_idx) AS r FROM kept) WHERE r = 1)"


@query(oracle(f"SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE invalid_state <> 0) AS invalid, {R6(*[(f'{f}({c})', f'{f}_{c}') for f in ('min', 'max') for c in 'xyz'])} FROM points GROUP BY scan_id"))
def scan_points_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan_points(spark, sf_dir)
    return p.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(F.col("invalid_state") != 0).alias("invalid"), *[F.round(getattr(F, f)(c), 6).alias(f"{f}_{c}") for f in ("min", "max") for c in "xyz"])


@query(
    oracle("""
SELECT scan_id, CASE WHEN s THEN 'structured' ELSE 'ambiguous' END AS kind, CASE WHEN s THEN 'structured scan' ELSE 'no gridding metadata' END AS summary,
  concat_ws(chr(10), CASE WHEN has_spherical THEN 'spherical coordinates in prototype — inherently single-origin' END,
    CASE WHEN grid THEN 'indexBounds declares a ' || (row_max - row_min + 1) || ' x ' || (col_max - col_min + 1) || ' grid' END,
    CASE WHEN rowcol_varies THEN 'rowIndex and columnIndex present and varying' END, CASE WHEN has_grouping THEN 'pointGroupingSchemes present' END,
    CASE WHEN NOT s THEN 'no spherical coordinates, no indexBounds, no row/column index, no pointGroupingSchemes' END,
    CASE WHEN NOT s AND NOT has_pose THEN 'no pose — a merged cloud typically has none' END) AS evidence
FROM (SELECT *, has_spherical OR grid OR rowcol_varies OR has_grouping AS s FROM (SELECT *, coalesce(row_max > row_min AND col_max > col_min, false) AS grid FROM meta))""")
)
def classify_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_metadata(scan_meta(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", "\n"))


@query(oracle(f"SELECT p.scan_id, count(*) AS n, CAST(sum(record_idx) AS BIGINT) AS ordinals FROM points p JOIN meta m ON p.scan_id = m.scan_id WHERE record_idx % {STEP.format(2000)} = 0 GROUP BY p.scan_id"))
def sample_stride_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = classify.stride_floor(scan_points(spark, sf_dir).select("scan_id", "record_idx"), scan_meta(spark, sf_dir), SMALL.sample_target)
    return kept.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("record_idx").alias("ordinals"))


@query(oracle(f"SELECT p.scan_id, count(*) AS n, {R6(*[(f'avg({c})', f'c{c}') for c in 'xyz'])} FROM points p JOIN meta m ON p.scan_id = m.scan_id WHERE record_idx % {STEP.format(2000)} = 0 AND invalid_state = 0 GROUP BY p.scan_id"))
def sample_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(classify.centroid(classify.sample(scan_points(spark, sf_dir), scan_meta(spark, sf_dir), SMALL)), 6, "cx", "cy", "cz")


BINS = """binned AS (SELECT scan_id, CAST(least(59, greatest(0, floor(acos(greatest(-1e0, least(1e0, z / rr))) / w))) AS INT) AS ie,
  CAST(least(119, greatest(0, floor((atan2(y, x) + 3.14159265358979e0) / w))) AS INT) AS ia, CAST(rr AS FLOAT) AS f
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS rr, 3e0 * 3.14159265358979e0 / 180e0 AS w FROM points WHERE invalid_state = 0) WHERE rr >= 1e-6),
bins AS (SELECT scan_id, ie, ia, count(*) AS n, min(f) AS lo, max(f) AS hi FROM binned GROUP BY ALL)"""


@query(oracle("SELECT scan_id, ie, ia, n, round(CAST(hi - lo AS DOUBLE), 3) AS spread FROM bins", BINS))
def direction_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, scans = scan_points(spark, sf_dir), scan_meta(spark, sf_dir)
    sampled = classify.sample(points, scans, T3)
    bins = classify.direction_bins(sampled, classify.test_origin(classify.centroid(sampled), scans), T3)
    return bins.select("scan_id", "ie", "ia", "n", F.round((F.col("hi") - F.col("lo")).cast("double"), 3).alias("spread"))


@query(
    oracle(
        """
SELECT m.scan_id, CASE WHEN share > 0.2e0 THEN 'unified/merged' WHEN share >= 0 OR grid OR has_spherical OR rowcol_varies OR has_grouping THEN 'structured' ELSE 'ambiguous' END AS kind,
  round(share, 6) AS fraction, coalesce(tested, 0) AS bins_tested, CAST(coalesce(used, 0) AS BIGINT) AS points_sampled
FROM (SELECT *, coalesce(row_max > row_min AND col_max > col_min, false) AS grid FROM meta) m LEFT JOIN (
  SELECT *, CASE WHEN tested >= 200 THEN multi / tested ELSE -1e0 END AS share FROM (
    SELECT scan_id, count(*) FILTER (WHERE n >= 4) AS tested, count(*) FILTER (WHERE n >= 4 AND hi - lo > CAST(0.5 AS FLOAT)) AS multi, sum(n) AS used FROM bins GROUP BY scan_id)) t
ON m.scan_id = t.scan_id""",
        BINS,
    )
)
def classify_(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify(scan_points(spark, sf_dir), scan_meta(spark, sf_dir), T3)
    return found.select("scan_id", "kind", F.round("fraction", 6).alias("fraction"), "bins_tested", "points_sampled")


for store in (QUERIES, ORACLES):
    store["classify"] = store.pop("classify_")

STATS = f"SELECT scan_id, count(*) AS decoded, count(*) FILTER (WHERE invalid_state <> 0) AS invalid, {', '.join(f'{f}({c}) FILTER (WHERE invalid_state = 0) AS {f}_{c}' for f in ('min', 'max', 'sum') for c in 'xyz')} FROM points GROUP BY scan_id"


@query(oracle(f"SELECT scan_id, decoded, invalid, {R6(*[(f'{f}_{c}', f'{f}_{c}') for f in ('min', 'max', 'sum') for c in 'xyz'])} FROM ({STATS})"))
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.scan_stats(scan_points(spark, sf_dir)), 6, *[f"{f}_{c}" for f in ("min", "max", "sum") for c in "xyz"])


@query(oracle(f"SELECT m.scan_id, 'cartesianInvalidState' AS field, coalesce(invalid, 0) AS invalid, record_count, round(coalesce(100e0 * invalid / nullif(record_count, 0), 0), 2) AS pct, CASE WHEN coalesce(invalid, 0) = 0 THEN 'never set' ELSE 'stored' END AS convention FROM meta m LEFT JOIN ({STATS}) s ON s.scan_id = m.scan_id"))
def no_return_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.no_return_report(scan_meta(spark, sf_dir), audit.scan_stats(scan_points(spark, sf_dir))), 2, "pct")


WITHIN = " AND ".join(f"min_{c} >= -bound - 1e-3 AND max_{c} <= bound + 1e-3" for c in "xyz")


@query(oracle(f"SELECT m.scan_id, {WITHIN} AS within, CASE WHEN {WITHIN} THEN 'OK' WHEN NOT ({WITHIN}) THEN '*** OUTSIDE DECLARED BOUNDS ***' END AS flag FROM meta m LEFT JOIN ({STATS}) s ON s.scan_id = m.scan_id"))
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.bounds_check(scan_meta(spark, sf_dir), audit.scan_stats(scan_points(spark, sf_dir)))


@query(
    oracle(f"""
SELECT scan_id, round(c, 6) AS centroid, round(p, 6) AS pose, CASE WHEN c IS NULL THEN 'unknown (no points decoded)' WHEN c < 5 THEN 'scanner-local (apply pose)'
  WHEN p > 1 AND abs(c - p) < 0.25e0 * p THEN 'global (pose already applied)' WHEN p < 1e-9 AND c > 50 THEN 'global (identity pose, far from origin)' ELSE 'ambiguous — inspect manually' END AS frame
FROM (SELECT m.scan_id, sqrt((sum_x / decoded) ** 2 + (sum_y / decoded) ** 2 + (sum_z / decoded) ** 2) AS c, sqrt(tx * tx + ty * ty + tz * tz) AS p
      FROM meta m LEFT JOIN ({STATS.replace('FROM points', 'FROM gpoints')}) s ON s.scan_id = m.scan_id)""")
)
def frame_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.frame_guess(scan_meta(spark, sf_dir), audit.scan_stats(scan_points_global(spark, sf_dir))), 6, "centroid", "pose")


@query(oracle(f"SELECT count(*) AS files, count(*) FILTER (WHERE problems > 0) AS files_failed, CAST(sum(problems) AS BIGINT) AS problems, CASE WHEN count(*) FILTER (WHERE problems > 0) > 0 THEN 1 ELSE 0 END AS exit_status FROM (SELECT m.scan_id % 2 AS path, sum(CASE WHEN NOT ({WITHIN}) THEN 1 ELSE 0 END + CASE WHEN coalesce(decoded, 0) <> record_count THEN 1 ELSE 0 END) AS problems FROM meta m LEFT JOIN ({STATS}) s ON s.scan_id = m.scan_id GROUP BY 1)"))
def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.failures(scan_meta(spark, sf_dir), audit.scan_stats(scan_points(spark, sf_dir)), F.col("scan_id") % 2)


@query(oracle(f"SELECT m.scan_id, name, record_count, decoded, invalid, round(100e0 * invalid / nullif(record_count, 0), 2) AS pct, CASE WHEN invalid = 0 THEN 'never set' ELSE 'stored' END AS convention, {WITHIN} AS within, CASE WHEN {WITHIN} THEN 'OK' ELSE '*** OUTSIDE DECLARED BOUNDS ***' END AS flag, 'scanner-local (apply pose)' AS frame, CASE WHEN decoded = record_count THEN 'OK' ELSE '*** MISMATCH ***' END AS count_flag FROM meta m JOIN ({STATS}) s ON s.scan_id = m.scan_id"))
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.audit(scan_points(spark, sf_dir), scan_meta(spark, sf_dir)), 2, "pct")


@query(oracle(f"SELECT scan_id, record_idx, {R6(('rng * cos(el) * cos(az)', 'x'), ('rng * cos(el) * sin(az)', 'y'), ('rng * sin(el)', 'z'))} FROM points"))
def spherical_to_cartesian_(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = spherical_to_cartesian(F.col("rng"), F.col("az"), F.col("el"))
    return rounded(scan_points(spark, sf_dir).select("scan_id", "record_idx", x.alias("x"), y.alias("y"), z.alias("z")), 6, "x", "y", "z")


for store in (QUERIES, ORACLES):
    store["spherical_to_cartesian"] = store.pop("spherical_to_cartesian_")


@query(oracle("SELECT scan_id, count(*) AS n, CAST(sum(record_idx) AS BIGINT) AS ordinals FROM kept GROUP BY scan_id", FEW))
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cloud.decimate(scan_points(spark, sf_dir), scan_meta(spark, sf_dir), BUDGET.max_points)
    return kept.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("record_idx").alias("ordinals"))


def _clouds(spark: SparkSession, sf_dir: str):
    scans = scan_meta(spark, sf_dir)
    kept = cloud.decimate(scan_points(spark, sf_dir), scans, LoadOptions().max_points)
    return scans, kept, cloud.origins(kept)


@query(oracle(f"SELECT scan_id, {R6(('ox', 'ox'), ('oy', 'oy'), ('oz', 'oz'))}, (SELECT count(*) FROM kept k WHERE k.scan_id = h.scan_id) AS n FROM heads h", KEPT, HEADS))
def cloud_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_clouds(spark, sf_dir)[2].select("scan_id", "ox", "oy", "oz", "n"), 6, "ox", "oy", "oz")


OFFSETS = ", ".join(f"round(CAST(CAST({c} - o{c} AS FLOAT) AS DOUBLE), 4) AS d{c}" for c in "xyz")


@query(oracle(f"SELECT k.scan_id, record_idx, {OFFSETS} FROM kept k JOIN heads h ON k.scan_id = h.scan_id", KEPT, HEADS))
def cloud_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, heads = _clouds(spark, sf_dir)
    return rounded(cloud.cloud_points(kept, heads).select("scan_id", "record_idx", "dx", "dy", "dz"), 4, "dx", "dy", "dz")


BOUNDS = "bounds AS (SELECT k.scan_id, " + ", ".join(f"CAST({f}({c} - o{c}) AS FLOAT) AS {n}_{c}" for n, f in (("lo", "min"), ("hi", "max")) for c in "xyz") + " FROM kept k JOIN heads h ON k.scan_id = h.scan_id GROUP BY k.scan_id)"
R4 = lambda *cols: ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {a}" for c, a in cols)
SIDES = [f"{n}_{c}" for n in ("lo", "hi") for c in "xyz"]


@query(oracle(f"SELECT scan_id, {R4(*[(s, s) for s in SIDES])} FROM bounds", KEPT, HEADS, BOUNDS))
def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, heads = _clouds(spark, sf_dir)
    return rounded(cloud.cloud_bounds(kept, heads), 4, *SIDES)


@query(oracle("SELECT scan_id, record_idx, " + ", ".join(f"CAST(floor(least(255e0, greatest(0e0, {c}))) AS INT) AS {a}" for c, a in (("red", "r"), ("green", "g"), ("blue", "b"))) + " FROM kept", KEPT))
def colour_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, heads = _clouds(spark, sf_dir)
    return cloud.cloud_points(kept, heads).select("scan_id", "record_idx", "r", "g", "b")


@query(oracle("SELECT scan_id, record_idx, CAST(floor(40 + 215 * least(1e0, greatest(0e0, (CAST(CAST(intensity AS FLOAT) AS DOUBLE) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END))) AS INT) AS grey FROM (SELECT *, min(intensity) OVER w AS lo, max(intensity) OVER w AS hi FROM kept WINDOW w AS (PARTITION BY scan_id))", KEPT))
def intensity_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, heads = _clouds(spark, sf_dir)
    return cloud.cloud_points(kept, heads, LoadOptions(prefer_colour=False)).select("scan_id", "record_idx", F.col("r").alias("grey"))


GREY = "CAST(floor(40 + 215 * least(1e0, greatest(0e0, (CAST(CAST(intensity AS FLOAT) AS DOUBLE) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END))) AS INT)"


@query(oracle("SELECT scan_id, record_idx, " + ", ".join(f"CASE WHEN scan_id % 2 = 0 AND scan_id < 4 THEN CAST(floor(least(255e0, greatest(0e0, {c}))) AS INT) WHEN scan_id < 4 THEN {GREY} ELSE 255 END AS {a}" for c, a in (("red", "r"), ("green", "g"), ("blue", "b"))) + " FROM (SELECT *, min(intensity) OVER w AS lo, max(intensity) OVER w AS hi FROM kept WINDOW w AS (PARTITION BY scan_id))", KEPT))
def attribute_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans 1, 3 and 4 have no colours, scan 4 no intensity either."""
    points = scan_points(spark, sf_dir)
    points = points.withColumns({c: F.when((F.col("scan_id") % 2 == 0) & (F.col("scan_id") < 4), F.col(c)) for c in ("red", "green", "blue")}).withColumn("intensity", F.when(F.col("scan_id") < 4, F.col("intensity")))
    kept = cloud.decimate(points, scan_meta(spark, sf_dir), LoadOptions().max_points)
    return cloud.cloud_points(kept, cloud.origins(kept)).select("scan_id", "record_idx", "r", "g", "b")


@query(oracle(f"SELECT h.scan_id, has_pose AS has_setup, {R4(('CAST(tx - ox AS FLOAT)', 'sx'), ('CAST(ty - oy AS FLOAT)', 'sy'), ('CAST(tz - oz AS FLOAT)', 'sz'))} FROM heads h JOIN meta m ON m.scan_id = h.scan_id", KEPT, HEADS))
def setup_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans, _, heads = _clouds(spark, sf_dir)
    return rounded(cloud.setup_positions(heads, scans), 4, "sx", "sy", "sz")


SCENE = "scene AS (SELECT h.scan_id, " + ", ".join(f"CAST(o{c} - (SELECT arg_min(o{c}, scan_id) FROM heads) AS FLOAT) AS f{c}" for c in "xyz") + " FROM heads h)"


@query(oracle(f"SELECT scan_id, {R4(('fx', 'fx'), ('fy', 'fy'), ('fz', 'fz'))} FROM scene", KEPT, HEADS, SCENE))
def scene_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cloud.scene_offsets(_clouds(spark, sf_dir)[2]).drop("n"), 4, "fx", "fy", "fz")


@query(oracle(f"SELECT {R4(*[(('min' if s[0] == 'l' else 'max') + f'({s} + f{s[-1]})', s) for s in SIDES])} FROM bounds b JOIN scene s ON s.scan_id = b.scan_id", KEPT, HEADS, BOUNDS, SCENE))
def scene_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, kept, heads = _clouds(spark, sf_dir)
    return rounded(cloud.scene_bounds(cloud.cloud_bounds(kept, heads), cloud.scene_offsets(heads)), 4, *SIDES)


@query("SELECT n, CASE WHEN n >= 1000000 THEN printf('%.1f M', n / 1e6) WHEN n >= 1000 THEN printf('%.1f k', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT DISTINCT n_chars * n_chars AS n FROM documents)")
def human_count_(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("n_chars") * F.col("n_chars")).alias("n")).distinct()
    return sizes.select("n", human_count(F.col("n")).alias("shown"))


for store in (QUERIES, ORACLES):
    store["human_count"] = store.pop("human_count_")
