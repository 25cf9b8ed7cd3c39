"""Observed space: which voxels some setup saw through, and which hold a surface.

The loop runs over voxels and setups near them, never along rays: a voxel looks
up the range image of each setup in its direction. Voxels are keys i, j, k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import direction, direction_bin, norm, rotate_back
from ..params import Grid, Thresholds

KEY = ["i", "j", "k"]


def voxel_of(grid: Grid, x, y, z):
    return [F.floor(v / grid.voxel).cast("int").alias(n) for v, n in zip((x, y, z), KEY)]


def universe(spark, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """All voxels of a box of keys, high excluded; made in parallel from a range."""
    nx, ny, nz = (h - l for l, h in zip(low, high))
    n = F.col("id")
    return spark.range(nx * ny * nz).select(
        (F.floor(n / (ny * nz)) + low[0]).cast("int").alias("i"), (F.floor(n / nz) % ny + low[1]).cast("int").alias("j"), (n % nz + low[2]).cast("int").alias("k")
    )


def occupied(points: DataFrame, grid: Grid) -> DataFrame:
    """Voxels with a valid point within reach of its setup (gx, gy, gz: its place in the world)."""
    valid = points.where((F.coalesce("invalid_state", F.lit(0)) == 0) & (norm(*map(F.col, "xyz")) <= grid.max_range))
    return valid.select(*voxel_of(grid, *(F.col(f"g{c}") for c in "xyz"))).distinct()


def near_setups(voxels: DataFrame, setups: DataFrame, grid: Grid) -> DataFrame:
    """Pairs of voxels and setups within range, by an equi-join on cells of that edge.

    A setup is listed in the 27 cells around its own, so that no voxel meets a
    setup more than two cells away and none within range is missed.
    """
    cell = lambda v: F.floor(v / grid.max_range)
    centre = voxels.withColumns({f"v{c}": (F.col(n) + 0.5) * grid.voxel for c, n in zip("xyz", KEY)})
    centre = centre.withColumns({f"c{c}": cell(F.col(f"v{c}")) for c in "xyz"})
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = setups.select("scan_id", "q", *[F.get("t", F.lit(n)).alias(f"t{c}") for n, c in enumerate("xyz")])
    for c in "xyz":
        around = around.withColumn(f"d{c}", F.explode(step))
    around = around.select("scan_id", "q", "tx", "ty", "tz", *[(cell(F.col(f"t{c}")) + F.col(f"d{c}")).alias(f"c{c}") for c in "xyz"])
    pairs = centre.join(around, ["cx", "cy", "cz"])
    local = rotate_back(F.col("q"), *(F.col(f"v{c}") - F.col(f"t{c}") for c in "xyz"))
    pairs = pairs.select(*KEY, "scan_id", *[v.alias(f"l{c}") for v, c in zip(local, "xyz")])
    rr, az, polar = direction(*(F.col(f"l{c}") for c in "xyz"))
    return pairs.withColumn("rr", rr).where(F.col("rr").between(1e-6, grid.max_range)).withColumns({"az": az, "polar": polar})


def seen_through(voxels: DataFrame, setups: DataFrame, image: DataFrame, grid: Grid, t: Thresholds) -> DataFrame:
    """(voxel, setup) pairs that the setup's range image clears, with range and angle from the vertical.

    ``image`` has range_cm per bin, null where a ray came back from nothing; a
    bin without a row was not looked at and clears nothing.
    """
    pairs = near_setups(voxels, setups, grid)
    ia, ie = direction_bin(F.col("az"), F.col("polar"), t)
    hit = pairs.withColumns({"ia": ia, "ie": ie}).join(image, ["scan_id", "ia", "ie"])
    reach = F.coalesce(F.least(F.col("range_cm") / 100.0 - grid.surface_margin, F.lit(grid.max_range)), F.lit(grid.max_range))
    angle = F.degrees(F.acos(F.least(F.abs("lz") / F.col("rr"), F.lit(1.0))))
    return hit.where(F.col("rr") < reach).select(*KEY, "scan_id", "rr", angle.alias("angle"))


def visible(voxels: DataFrame, setups: DataFrame, image: DataFrame, grid: Grid, t: Thresholds) -> DataFrame:
    """Voxels that some setup clears."""
    return seen_through(voxels, setups, image, grid, t).select(*KEY).distinct()


def quality(voxels: DataFrame, setups: DataFrame, image: DataFrame, grid: Grid, t: Thresholds) -> DataFrame:
    """Per cleared voxel: setups that clear it, least angle from the vertical (degrees), nearest range."""
    return seen_through(voxels, setups, image, grid, t).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("angle").alias("best_angle"), F.min("rr").alias("nearest"))


def unknown(voxels: DataFrame, seen: DataFrame, full: DataFrame) -> DataFrame:
    return voxels.join(seen, KEY, "left_anti").join(full, KEY, "left_anti")


def pack_bricks(voxels: DataFrame) -> DataFrame:
    """Bricks of 8 x 8 x 8 bits: word k holds the layer k, bit i + 8 j a voxel."""
    inner = lambda c: F.col(c).bitwiseAND(7)
    bit = F.expr("shiftleft(1L, (i & 7) + 8 * (j & 7))")
    keys = [F.shiftright(c, 3).alias(f"b{c}") for c in KEY]
    words = [F.coalesce(F.bit_or(F.when(inner("k") == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(8)]
    return voxels.groupBy(*keys).agg(*words)


def unpack_bricks(bricks: DataFrame) -> DataFrame:
    """The voxels of packed bricks."""
    word = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"w{w}").alias("bits")) for w in range(8)]))
    words = bricks.select("bi", "bj", "bk", word.alias("x")).where("x.bits <> 0")
    bits = words.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("(shiftrightunsigned(x.bits, b) & 1L) = 1"))
    return bits.select(F.expr("CAST(bi * 8 + (b & 7) AS INT)").alias("i"), F.expr("CAST(bj * 8 + shiftright(b, 3) AS INT)").alias("j"), F.expr("CAST(bk * 8 + x.w AS INT)").alias("k"))
