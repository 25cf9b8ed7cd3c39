"""Verdicts, cameras and voids on small made scenes."""

import numpy as np
import pytest

from lacuna.operators import camera, carve, classify, pick, voids
from lacuna.params import Grid, Thresholds


def shells(n, count, seed):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n * count, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    r = 5 + 1.5 * d[:, 0] * d[:, 1] + 3 * np.repeat(np.arange(count), n)
    return d * r[:, None]


def scene(spark, clouds, pose=None):
    rows = [(k, i, *map(float, p), 0) for k, cloud in enumerate(clouds) for i, p in enumerate(cloud)]
    points = spark.createDataFrame(rows, "scan_id int, record_idx long, x double, y double, z double, invalid_state int")
    meta = [(k, pose is not None, list(pose or (0.0, 0.0, 0.0)), len(c), False, None, None, None, None, False, [("cartesianX", "Float", 64)]) for k, c in enumerate(clouds)]
    scans = spark.createDataFrame(meta, "scan_id int, has_pose boolean, t array<double>, record_count long, has_index_bounds boolean, row_min long, row_max long, col_min long, col_max long, has_point_grouping boolean, proto array<struct<name: string, type: string, bits: int>>")
    return points, scans


def test_shells_are_told_apart(spark):
    points, scans = scene(spark, [shells(9000, 1, 1), shells(6000, 3, 2), shells(40, 1, 3)])
    got = {r.scan_id: r for r in classify.classify(points, scans, Thresholds(bin_degrees=4.0)).collect()}
    assert got[0].kind == "structured" and 0 <= got[0].fraction < 0.2 and got[0].summary.startswith("single origin")
    assert got[1].kind == "unified/merged" and got[1].fraction > 0.2
    assert got[2].kind == "ambiguous" and got[2].fraction == -1 and got[2].evidence[-1].startswith("geometric test skipped")


def test_every_record_is_tested_unless_a_sample_is_asked_for(spark):
    points, scans = scene(spark, [shells(3000, 1, 1)])
    long = scans.selectExpr("* EXCEPT (record_count)", "600000L AS record_count")
    assert classify.classify(points, long).first().points_sampled == 3000
    assert classify.classify(points, long, Thresholds(sample_target=200_000)).first().points_sampled == 1000


def test_moved_points_are_tested_about_the_pose(spark):
    points, scans = scene(spark, [shells(9000, 1, 1) + [500.0, 20.0, 3.0]], (500.0, 20.0, 3.0))
    got = classify.classify(points, scans, Thresholds(bin_degrees=4.0)).first()
    assert got.kind == "structured" and "testing about the pose translation (points appear pre-transformed)" in got.evidence


def test_counts_are_shown_as_c_shows_them(spark):
    from lacuna.functions.text import human_count

    ns = [0, 999, 1000, 1049, 1050, 1150, 1250, 1350, 99_950, 999_949, 999_950, 999_999, 1_000_000, 1_150_000, 2_250_000, 6_250_000, 12_250_000, 20_250_000, 10**15 + 50_000, 2**53 - 1, 2**63 - 1]
    ns += [1000 + 50 * k for k in range(2000)] + [50_000 * k for k in range(20, 3000)] + np.random.default_rng(1).integers(0, 2**50, 3000).tolist()
    shown = lambda n: f"{n / 1e6:.1f} M" if n >= 1_000_000 else f"{n / 1e3:.1f} k" if n >= 1_000 else str(n)
    got = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r for r in got.select("n", human_count(got.n).alias("shown")).collect() if r.shown != shown(r.n)] == []


def view():
    out = camera.OrbitCamera()
    out.set_viewport(800, 600)
    out.frame((-1, -1, -1), (1, 1, 1))
    return out


def test_camera_frames_and_turns():
    c = view()
    p = c.matrix() @ np.array([0, 0, 0, 1], np.float32)
    assert abs(p[0] / p[3]) < 1e-5 and abs(p[1] / p[3]) < 1e-5 and 0 < p[2] / p[3] < 1
    for corner in np.ndindex(2, 2, 2):
        q = c.matrix() @ np.array([*(2 * np.array(corner) - 1), 1], np.float32)
        assert abs(q[0]) <= q[3] and abs(q[1]) <= q[3]
    yaw = c.yaw
    c.orbit(800, 0)
    assert np.isclose(yaw - c.yaw, np.pi)
    c.orbit(0, 1e6)
    assert np.isclose(c.pitch, np.radians(89))
    d = c.distance
    c.zoom(1)
    assert np.isclose(c.distance, d * np.exp(-0.15), rtol=1e-4)
    c.zoom(1e6)
    assert np.isclose(c.distance, c.closest)


def test_pivot_moves_without_the_eye():
    c = view()
    eye = c.eye()
    c.set_pivot_keeping_eye((0.5, -0.25, 0.1))
    assert np.allclose(c.eye(), eye, atol=1e-4)
    before = c.pivot.copy()
    c.set_pivot_keeping_eye(c.eye())
    assert np.allclose(c.pivot, before)


def test_unproject_undoes_project():
    c = view()
    p = c.matrix() @ np.array([0.3, -0.2, 0.4, 1], np.float32)
    assert np.allclose(c.unproject(*(p[:3] / p[3])), [0.3, -0.2, 0.4], atol=1e-3)
    assert c.unproject(0, 0, 1.0) is None
    assert camera.inverse(np.zeros((4, 4), np.float32)) is None


@pytest.mark.parametrize("parts", [1, 7])
def test_pick_takes_the_nearer_plane(spark, parts):
    grid = spark.range(41 * 41 * 2).selectExpr("CAST(id % 2 AS INT) AS scan_id", "id AS record_idx", "(id DIV 2) % 41 * 0.25D - 5 AS x", "(id DIV 82) * 0.25D - 5 AS y", "id % 2 * 4D AS z").repartition(parts)
    c = view()
    c.frame((-5, -5, 0), (5, 5, 4))
    c.pitch = float(np.radians(80))
    got = pick.pick_nearest(grid, c, 0.0, 0.0, 30).collect()
    assert len(got) == 1 and got[0].z == 4
    assert pick.pick_nearest(grid, c, 40.0, 40.0, 1).collect() == []


def keys(df):
    return {(r.i, r.j, r.k) for r in df.collect()}


def test_voids_by_brute_force(spark):
    rng = np.random.default_rng(4)
    box = [tuple(map(int, p)) for p in np.ndindex(7, 7, 4)]
    kind = {p: rng.choice(["seen", "full", "free"], p=[0.1, 0.3, 0.6]) for p in box}
    frame = lambda which: spark.createDataFrame([p for p in box if which in (kind[p], None)], "i int, j int, k int")
    near = lambda p: [tuple(a + b for a, b in zip(p, s)) for s in voids.STEPS]
    reached, front = set(), {p for p in box if kind[p] == "seen"}
    for _ in range(3):
        front = {q for p in front for q in near(p) if kind.get(q) == "free"} - reached
        reached |= front
    found = voids.cut(voids.dilate(frame("seen"), frame("full"), frame(None), 3, cut_every=2))
    assert keys(found) == reached
    label = {p: p for p in reached}
    while True:
        new = {p: min([label[p], *(label[q] for q in near(p) if q in label)]) for p in label}
        if new == label:
            break
        label = new
    groups = {}
    for r in voids.components(found).collect():
        groups.setdefault(r.comp, set()).add((r.i, r.j, r.k))
    want = {}
    for p, l in label.items():
        want.setdefault(l, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_footprint_closes_and_fills(spark):
    ring = [(i, j) for i in range(9) for j in range(9) if i in (0, 8) or j in (0, 8)]
    cells = spark.createDataFrame(ring, "i int, j int")
    assert {(r.i, r.j) for r in voids.fill_holes(cells).collect()} == {(i, j) for i in range(9) for j in range(9)}
    assert voids.fill_holes(cells.limit(0)).collect() == []


def test_bricks_hold_every_voxel(spark):
    rng = np.random.default_rng(5)
    cells = {tuple(map(int, p)) for p in rng.integers(-20, 20, (300, 3))}
    bricks = carve.pack_bricks(spark.createDataFrame(sorted(cells), "i int, j int, k int")).collect()
    back = {(r.bi * 8 + b % 8, r.bj * 8 + b // 8, r.bk * 8 + w) for r in bricks for w in range(8) for b in range(64) if (r[f"w{w}"] >> b) & 1}
    assert back == cells


def test_more_setups_see_more(spark):
    grid, t = Grid(voxel=1.0, max_range=6.0), Thresholds(bin_degrees=30.0)
    image = spark.range(2 * 72).selectExpr("CAST(id DIV 72 AS INT) AS scan_id", "CAST(id % 12 AS INT) AS ia", "CAST(id % 72 DIV 12 AS INT) AS ie", "400 AS range_cm")
    setups = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], [0.5, 0.5, 0.5]), (1, [0.0, 0.0, 0.0, 1.0], [7.5, 0.5, 0.5])], "scan_id int, q array<double>, t array<double>")
    space = carve.universe(spark, (-6, -6, -6), (14, 6, 6))
    one, both = (keys(carve.visible(space, s, image, grid, t)) for s in (setups.where("scan_id = 0"), setups))
    assert one < both
    reach = 4.0 - grid.surface_margin
    centre = lambda p, t: sum((a + 0.5 - b) ** 2 for a, b in zip(p, t)) ** 0.5
    assert both == {p for p in keys(space) if any(1e-6 < centre(p, t) < reach for t in ((0.5, 0.5, 0.5), (7.5, 0.5, 0.5)))}


def test_gaps_and_fields_of_view(spark):
    from lacuna.operators import rangeimage

    # Scan 0 looks everywhere but at bins 20 to 30; scan 1 across the seam at 55 to 4; scan 2 around the circle with small gaps.
    seen = {0: [*range(20), *range(31, 60)], 1: [*range(55, 60), *range(5)], 2: [*range(60)], 3: [7]}
    bins = spark.createDataFrame([(k, ia, ie, 100) for k, own in seen.items() for ia in own for ie in (k, k + 3)], "scan_id int, ia int, ie int, range_cm int")
    gaps = {(r.scan_id, r.ia): r.gap for r in rangeimage.azimuth_gaps(bins, 60).collect()}
    assert len(gaps) == sum(map(len, seen.values())) and (gaps[0, 19], gaps[0, 59], gaps[1, 4], gaps[3, 7]) == (12, 1, 51, 60)
    fov = {r.scan_id: (r.ie_from, r.ie_to, r.ia_from, r.ia_extent) for r in rangeimage.field_of_view(bins, 60).collect()}
    assert fov == {0: (0, 3, 31, 49), 1: (1, 4, 55, 10), 2: (2, 5, 0, 60), 3: (3, 6, 7, 1)}


def test_directions_without_a_return_are_clear(spark):
    image = spark.createDataFrame([(0, ia, ie, 300 if ia < 30 else None) for ia in range(60) for ie in range(30)], "scan_id int, ia int, ie int, range_cm int")
    setups = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0])], "scan_id int, q array<double>, t array<double>")
    grid, t = Grid(voxel=1.0, max_range=6.0), Thresholds(bin_degrees=6.0)
    seen = {(r.i, r.j, r.k) for r in carve.visible(carve.universe(spark, (-8, -8, -8), (8, 8, 8)), setups, image, grid, t).collect()}
    for v in np.ndindex(16, 16, 16):
        x, y, z = (c - 8 + 0.5 for c in v)
        r = np.sqrt(x * x + y * y + z * z)
        hit = min(29, np.floor((np.arctan2(y, x) + np.pi) / np.radians(6))) < 30 and np.arctan2(y, x) < 0
        assert (tuple(c - 8 for c in v) in seen) == (r <= 6 and r < (3 - grid.surface_margin if hit else 6))


def test_bricks_give_their_voxels_back(spark):
    rng = np.random.default_rng(7)
    want = {tuple(map(int, v)) for v in rng.integers(-20, 20, (300, 3))} | {(7, 7, 7), (-1, -1, -1)}
    voxels = spark.createDataFrame(sorted(want), "i int, j int, k int")
    assert {(r.i, r.j, r.k) for r in carve.unpack_bricks(carve.pack_bricks(voxels)).collect()} == want
