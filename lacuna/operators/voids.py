"""From unseen space to reported voids.

The wavefront and the components are driver loops over distributed rounds, cut
by checkpoints; a round ships only the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Grid
from .carve import KEY
from .graph import components as connected
from .graph import cut

SHADOW, UNVISITED, REVIEW = "SHADOW", "UNVISITED", "REVIEW"
STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: Room for each of three coordinates in a packed key.
BITS, BIAS = 21, 1 << 20


def neighbours(voxels: DataFrame, steps=STEPS, names=KEY) -> DataFrame:
    """All voxels one step away, one row per step."""
    moves = F.array(*[F.struct(*[(F.col(n) + d).alias(n) for n, d in zip(names, s)]) for s in steps])
    return voxels.select(F.explode(moves).alias("m")).select(*[F.col(f"m.{n}") for n in names])


def dilate(seen: DataFrame, full: DataFrame, inside: DataFrame, steps: int, cut_every: int = 5) -> DataFrame:
    """Voxels reached from ``seen`` in at most ``steps`` face steps within ``inside``, not through ``full``, without ``seen``."""
    free = inside.join(full, KEY, "left_anti").join(seen, KEY, "left_anti")
    found, frontier = None, seen
    for n in range(1, steps + 1):
        new = free.join(neighbours(frontier).distinct(), KEY, "left_semi")
        free = free.join(new, KEY, "left_anti")
        found = new if found is None else found.unionByName(new)
        frontier = new
        if n % cut_every == 0 or n == steps:
            frontier, free, found = cut(frontier), cut(free), cut(found)
            if frontier.isEmpty():
                break
    return found if found is not None else seen.limit(0)


def packed(names=KEY):
    return reduce(lambda a, n: a * (1 << BITS) + (F.col(n) + BIAS), names, F.lit(0).cast("long"))


def components(voids: DataFrame, names=KEY, steps=STEPS) -> DataFrame:
    """Voxels with the least key of their face-connected component (comp)."""
    half = [s for s in steps if s > tuple(0 for _ in s)]
    moved = F.array(*[F.struct(*[(F.col(n) + d).alias(n) for n, d in zip(names, s)]) for s in half])
    pairs = voids.select(packed(names).alias("u"), F.explode(moved).alias("m")).select("u", *[F.col(f"m.{n}").alias(n) for n in names])
    edges = pairs.join(voids, names, "left_semi").select("u", packed(names).alias("v"))
    keyed = voids.withColumn("node", packed(names))
    return keyed.join(connected(edges), "node", "left").select(*names, F.coalesce("root", "node").alias("comp"))


def report(labelled: DataFrame, seen: DataFrame, grid: Grid, largest_shadow: float, smallest_unvisited: float, aperture: tuple[float, float] = (0.8, 2.1)) -> DataFrame:
    """One row per component that is large enough: volume, centroid, extent, contact with seen space, class.

    A small one that touches seen space is a shadow; a large one that touches it
    through about a doorway is unvisited; the rest is for people to look at.
    """
    faces = F.array(*[F.struct(*[(F.col(n) + d).alias(n) for n, d in zip(KEY, s)]) for s in STEPS])
    contact = labelled.select("comp", F.explode(faces).alias("m")).select("comp", *[F.col(f"m.{n}") for n in KEY]).join(seen, KEY, "left_semi").groupBy("comp").agg(F.count("*").alias("faces"))
    v = grid.voxel
    shape = labelled.groupBy("comp").agg(
        F.count("*").alias("voxels"),
        *[((F.avg(n) + 0.5) * v).alias(f"c{c}") for n, c in zip(KEY, "xyz")],
        *[(F.min(n) * v).alias(f"lo_{c}") for n, c in zip(KEY, "xyz")],
        *[((F.max(n) + 1) * v).alias(f"hi_{c}") for n, c in zip(KEY, "xyz")],
    )
    whole = shape.withColumn("volume", F.col("voxels") * v**3).where(F.col("volume") >= grid.void_volume).join(contact, "comp", "left").fillna({"faces": 0})
    width = F.sqrt(F.col("faces") * v * v)
    kind = F.when((F.col("faces") > 0) & (F.col("volume") <= largest_shadow), SHADOW).when((F.col("volume") >= smallest_unvisited) & width.between(*aperture), UNVISITED).otherwise(REVIEW)
    return whole.withColumn("class", kind)


def storeys(points: DataFrame, height: float) -> DataFrame:
    """Histogram of z with its peaks (levels with more points than both neighbours)."""
    counts = points.groupBy(F.floor(F.col("z") / height).cast("int").alias("level")).agg(F.count("*").alias("n"))
    w = Window.orderBy("level")  # one row per level: a building has few
    near = lambda f: F.when(f("level").over(w) == F.col("level") + (1 if f is F.lead else -1), f("n").over(w)).otherwise(0)
    return counts.withColumns({"below": near(F.lag), "above": near(F.lead)}).select("level", "n", ((F.col("n") > F.coalesce("below", F.lit(0))) & (F.col("n") > F.coalesce("above", F.lit(0)))).alias("peak"))


AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
PLAN = ["i", "j"]


def grow(cells: DataFrame) -> DataFrame:
    """Plan cells and the eight around each."""
    return neighbours(cells, AROUND, PLAN).distinct()


def shrink(cells: DataFrame) -> DataFrame:
    """Plan cells all of whose eight neighbours are there."""
    return neighbours(cells, AROUND, PLAN).groupBy(*PLAN).agg(F.count("*").alias("n")).where("n = 9").select(*PLAN)


def fill_holes(cells: DataFrame) -> DataFrame:
    """Plan cells, and those that cannot be left to the outside by face steps."""
    span = cells.agg(*[f(n).alias(f"{m}_{n}") for n in PLAN for m, f in (("lo", F.min), ("hi", F.max))])
    frame = span.where("lo_i IS NOT NULL").select(F.explode(F.sequence(F.col("lo_i") - 1, F.col("hi_i") + 1)).alias("i"), "lo_i", "lo_j", "hi_j").withColumn("j", F.explode(F.sequence(F.col("lo_j") - 1, F.col("hi_j") + 1)))
    empty = cut(frame.select("i", "j", ((F.col("i") == F.col("lo_i") - 1) & (F.col("j") == F.col("lo_j") - 1)).alias("corner")).join(cells, PLAN, "left_anti"))
    labelled = components(empty.select(*PLAN), PLAN, [(1, 0), (-1, 0), (0, 1), (0, -1)])
    outside = labelled.join(empty.where("corner").select(*PLAN), PLAN, "left_semi").select("comp")
    return cells.select(*PLAN).unionByName(labelled.join(F.broadcast(outside), "comp", "left_anti").select(*PLAN)).distinct()


def footprint(seen: DataFrame, wall_cells: int = 1) -> DataFrame:
    """The plan of seen space: closed, holes filled, grown by the walls."""
    out = fill_holes(cut(shrink(grow(seen.select(*PLAN).distinct()))))
    for _ in range(wall_cells):
        out = grow(out)
    return out


def clip(voids: DataFrame, plan: DataFrame) -> DataFrame:
    return voids.join(plan, PLAN, "left_semi")


def within_envelope(voids: DataFrame, envelope: DataFrame) -> DataFrame:
    return voids.join(envelope, KEY, "left_semi")


def setup_distribution(scans: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """How many setups stand inside a box, outside, or nowhere known."""
    inside = F.lit(True)
    for n, (a, b) in enumerate(zip(low, high)):
        inside = inside & F.get("t", F.lit(n)).between(a, b)
    where = F.when(~F.col("has_pose"), "unknown").when(inside, "inside").otherwise("outside")
    return scans.groupBy(where.alias("place")).agg(F.count("*").alias("setups"), F.sum("record_count").alias("points"))
