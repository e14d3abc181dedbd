"""Epipolar curves, free falls and project folders: planted answers, torn saves, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.functions import scalars as S
from motionframe.operators import epipolar, falls
from motionframe.plans.adapter import DLT
from motionframe.sources import project_folder
from tests.test_clocks_series import pixel

# ---- rays --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rig(spark):
    return spark.createDataFrame([(c, list(map(float, k)), 1280, 720) for c, k in enumerate(DLT)], "cam int, coefs array<double>, width int, height int")


def test_true_pixels_lie_on_their_curves(spark, rig):
    g = np.random.default_rng(8)
    points = g.normal(size=(25, 3)) * 0.15
    obs = spark.createDataFrame([("p", i, c, *map(float, pixel(c, p))) for i, p in enumerate(points) for c in range(4)], "name string, frame long, cam int, u double, v double")
    seg = epipolar.pair_segments(obs, rig)
    d = seg.join(obs.select("name", "frame", F.col("cam").alias("dst"), "u", "v"), ["name", "frame", "dst"]).withColumn("q", S.closest_on_polyline(F.col("segment"), F.col("u"), F.col("v")))
    rows = d.select("q.d", "segment").collect()
    assert len(rows) == 25 * 12 and max(r.d for r in rows) < 1e-6
    for r in rows:
        assert all(-320.5 - 1e-6 <= p.x <= 1599.5 + 1e-6 and -180.5 - 1e-6 <= p.y <= 899.5 + 1e-6 for p in r.segment)
    got = epipolar.ray_targets(obs, rig).collect()
    assert len(got) == 100 and {r.lines for r in got} == {3}
    for r in got:
        u, v = pixel(r.cam, points[r.frame])
        assert r.mode == "crossing" and math.hypot(r.x - u, r.y - v) < 1e-5


def test_targets_of_few_and_parallel_lines(spark, rig):
    p = np.array([0.05, -0.1, 0.02])
    obs = spark.createDataFrame([("p", 0, 1, *map(float, pixel(1, p)))], "name string, frame long, cam int, u double, v double")
    got = {r.cam: r for r in epipolar.ray_targets(obs, rig).collect()}
    assert set(got) == {0, 2, 3} and {r.mode for r in got.values()} == {"one"}
    line = lambda *xy: [tuple(map(float, xy[i : i + 2])) for i in (0, 2)]
    rows = [(0, [line(0, 0, 100, 0), line(0, 2, 100, 3)]), (1, [line(0, 0, 100, 0), line(50, -50, 50, 50)]), (2, []), (3, [line(5, 5, 5, 5)])]
    d = spark.createDataFrame(rows, "k int, lines array<array<struct<x: double, y: double>>>")
    out = {r.k: r.t for r in d.select("k", epipolar.crossing("lines", F.lit(20.0), F.lit(10.0)).alias("t")).collect()}
    assert out[0].mode == "parallel" and out[0].x == pytest.approx(20.05, abs=0.1) and out[1].mode == "crossing" and (out[1].x, out[1].y) == pytest.approx((50, 0))
    assert out[2] is None and out[3].mode == "one"


def test_bent_curves_keep_what_is_inside(spark):
    seg = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(10.0).alias("x"), F.lit(0.0).alias("y")))
    d = spark.range(1).select(epipolar.sampled_curve(seg, 11, lambda x, y: (x, y + x * x / 10), lambda x, y: x <= 7).alias("c"))
    assert [(p.x, p.y) for p in d.first().c] == [(float(i), i * i / 10) for i in range(8)]


# ---- falls -------------------------------------------------------------------------------------------------


def test_falls(spark):
    rows = []
    height = [50.0] * 10 + [50 + 0.4 * k * k for k in range(1, 25)] + [280 - 0.4 * (25 * k) for k in range(1, 12)]  # rest, fall, bounce
    g = np.random.default_rng(2)
    for cam, scale in (("a", 1.0), ("b", 1.3)):
        for t, y in enumerate(height):
            rows.append((cam, "ball", t, 100.0, y * scale))
            rows.append((cam, "mark", t, 30.0 + g.normal() * 0.3, 20.0 + g.normal() * 0.3))
            rows.append((cam, "still", t, 5.0, 5.0))
        rows += [(cam, "short", t, 9.0 * t, 0.0) for t in range(5)]
    rows += [("a", "alone", t, 9.0 * t, 0.0) for t in range(40)]
    d = spark.createDataFrame(rows, "camera string, name string, t long, x double, y double")
    cameras = spark.createDataFrame([("a", 640, 480), ("b", 640, 480)], "camera string, width int, height int")
    (got,) = falls.falls(d, cameras).collect()
    assert got.name == "ball" and got.rest_left_out and got.end_left_out
    first = next(k for k in range(9, 40) if height[k + 1] - height[k] >= 1 / 1.15)
    assert abs(got.first - (first - 2)) <= 1 and got.last == 33
    assert falls.falls(d.where("false"), cameras).count() == 0


# ---- folders -----------------------------------------------------------------------------------------------


def test_project_folder(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(c, n, f, float(f), None if f % 3 else "") for c in "ab" for n in ("x", "y") for f in range(5)]
    d = spark.createDataFrame(rows, "camera string, name string, frame long, v double, note string")
    plain = lambda df: sorted(map(str, df.select(*d.columns).collect()))
    with pytest.raises(ValueError):
        project_folder.load(spark, path)
    assert project_folder.save(d, path) == 1 and plain(project_folder.load(spark, path)) == plain(d)
    assert project_folder.save(d.repartition(5, "frame"), path) == 1  # nothing changed, whatever the order
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "p" / "data").rglob("*.parquet")}
    edited = d.withColumn("note", F.when((F.col("camera") == "a") & (F.col("name") == "x") & (F.col("frame") == 3), None).otherwise(F.col("note")))
    assert project_folder.save(edited, path) == 2 and plain(project_folder.load(spark, path)) == plain(edited)
    assert {p: p.stat().st_mtime_ns for p in files} == files and {(r.camera, r.name): r.version for r in project_folder.manifest(spark, path).collect()} == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 1}
    exports = project_folder.digests(d)
    assert [tuple(r) for r in project_folder.stale_exports(spark, path, exports).collect()] == [("a", "x")]
    # A save that was torn: data without a manifest, and a manifest without its last file.
    d.withColumn("v", F.lit(-1.0)).write.partitionBy("camera", "name").parquet(f"{path}/data/version=3")
    project_folder.manifest(spark, path).write.parquet(f"{path}/manifest/version=3")
    (tmp_path / "p" / "manifest" / "version=3" / "_SUCCESS").unlink()
    assert project_folder.versions(spark, path) == [1, 2] and plain(project_folder.load(spark, path)) == plain(edited)
    gone = edited.where("name = 'y'")
    assert project_folder.save(gone, path) == 4 and plain(project_folder.load(spark, path)) == plain(gone) and plain(project_folder.load(spark, path, 2)) == plain(edited)
    assert project_folder.roll_back(spark, path, 1) == 5 and plain(project_folder.load(spark, path)) == plain(d)
    assert project_folder.damaged(spark, path).count() == 0
    spark.createDataFrame([(9, 9.0, "")], "frame long, v double, note string").write.mode("append").parquet(f"{path}/data/version=1/camera=b/name=x")
    assert [tuple(r) for r in project_folder.damaged(spark, path).collect()] == [("b", "x")]


# ---- surfaces ----------------------------------------------------------------------------------------------


def test_distance_field_and_surface(spark):
    from motionframe.operators import surface

    n = (7, 6, 5)
    solid = [(x, y, z) for x in range(7) for y in range(6) for z in range(5) if (x - 3) ** 2 / 9 + (y - 2.5) ** 2 / 6 + (z - 2) ** 2 / 4 <= 1]
    d = spark.createDataFrame(solid + solid[:2], "ix long, iy long, iz long")
    box = [(x, y, z) for x in range(-1, 8) for y in range(-1, 7) for z in range(-1, 6)]
    got = {(r.ix, r.iy, r.iz): r.value for r in surface.signed_distance(d, n).collect()}
    inside = set(solid)
    near = lambda p, others: min(math.dist(p, q) for q in others)
    assert set(got) == set(box)
    for p in box:
        want = near(p, [q for q in box if q not in inside]) if p in inside else -near(p, inside)
        assert got[p] == pytest.approx(want), p
    field = surface.signed_distance(d, n)
    soup = surface.surface(field)
    rows = [np.array([r.a, r.b, r.c]) for r in soup.collect()]
    # Closed and outward: directed areas cancel, and the volume is between the voxels eroded and dilated by half.
    assert np.allclose(sum(np.cross(t[1] - t[0], t[2] - t[0]) for t in rows), 0, atol=1e-9)
    volume = sum(np.dot(t[0], np.cross(t[1], t[2])) for t in rows) / 6
    assert 0.5 * len(solid) < volume < 1.3 * len(solid) and surface.enclosed(soup, 2.0).first().volume == pytest.approx(8 * volume)
    vertices, faces = surface.welded(soup, (0.0, 0.0, 0.0), 1.0)
    edges = faces.select(F.explode(F.array(*(F.array(a, b) for a, b in ("ab", "bc", "ca")))).alias("e")).select(F.array_sort("e").alias("e"), (F.get("e", F.lit(0)) < F.get("e", F.lit(1))).alias("up"))
    odd = edges.groupBy("e").agg(F.count_if("up").alias("u"), F.count("*").alias("n")).where("u * 2 <> n")
    assert odd.count() == 0 and vertices.count() - edges.select("e").distinct().count() + faces.count() == 2  # one closed surface without holes
    assert {r.value for r in surface.signed_distance(d.where("false"), (2, 2, 2)).collect()} == {-1.0}
    assert surface.surface(surface.signed_distance(d.where("false"), (2, 2, 2))).count() == 0
    flat = surface.blurred(field.withColumn("value", F.lit(2.5)), 1.0).agg(F.min("value"), F.max("value")).first()
    assert flat[0] == pytest.approx(2.5) and flat[1] == pytest.approx(2.5)


# ---- lenses and constellations -----------------------------------------------------------------------------


def test_lens_maps_equal_plain_weights(spark):
    from motionframe.operators import lenses

    g = np.random.default_rng(6)
    src = np.array([(x + g.normal(), y + g.normal()) for x in range(0, 200, 20) for y in range(0, 140, 20)])
    dst = np.column_stack([src[:, 0] * 1.02 + 4 * np.sin(src[:, 1] / 40), src[:, 1] + 3 * np.cos(src[:, 0] / 30)])
    points = [("l", *map(float, p), *map(float, q)) for p, q in zip(src, dst)] + [("few", float(i), 0.0, 1.0, 1.0) for i in range(5)]
    pixels = [(i, "l", float(x), float(y)) for i, (x, y) in enumerate(g.uniform(-40, 240, size=(60, 2)))] + [(90, "few", 1.0, 0.0), (91, "none", 1.0, 0.0), (92, "l", None, 1.0)]
    d = spark.createDataFrame(pixels, "i int, lens string, x double, y double")
    fits = lenses.fitted(spark.createDataFrame(points, "lens string, x double, y double, to_x double, to_y double"))
    got = {r.i: (r.x, r.y) for r in lenses.mapped(d, fits, ("i",)).collect()}
    terms = lambda p: np.array([1, p[0], p[1], p[0] * p[1], p[0] ** 2, p[1] ** 2])
    own = []
    for p in src:
        near = np.argsort(np.linalg.norm(src - p, axis=1))[:12]
        own.append((np.linalg.norm(src[near] - p, axis=1).max(), np.linalg.lstsq(np.array([terms(q) for q in src[near]]), dst[near], rcond=None)[0]))
    some = 0
    for i, lens, *p in pixels[:60]:
        w = [1 - 3 * r**2 + 2 * r**3 if (r := math.dist(p, s) / reach) < 1 else 0 for s, (reach, _) in zip(src, own)]
        if sum(w):
            want = sum(k * (terms(p) @ c) for k, (_, c) in zip(w, own)) / sum(w)
            assert got[i] == pytest.approx(tuple(want), abs=1e-6)
            some += 1
        else:
            assert got[i] == (None, None)
    assert 20 < some < 60 and got[90] == got[91] == got[92] == (None, None) and len(got) == 63


def test_constellations(spark):
    from motionframe.operators import lenses

    g = np.random.default_rng(7)
    seed = g.uniform(-30, 30, size=(10, 2))
    turned = seed @ np.array([[0, 1.5], [-1.5, 0]]) + [100, 80]
    rows = []

    def add(frame, now, radius=20.0, conf=0.9, visible=True):
        rows.extend((frame, *map(float, s), 1.0, 2.0, radius, *map(float, n), conf, visible) for s, n in zip(seed, now))

    add(0, turned)
    swapped = turned.copy()
    swapped[:4] = turned[3::-1]
    add(1, swapped)
    add(2, seed * 5 + 300)  # too large a scale: the median displacement
    add(3, seed + [7, -3] + 40, radius=5.0)  # too small a group
    add(4, seed - 1000)  # nobody on the picture
    half = turned.copy()
    half[5:] = -900
    add(5, half, visible=False)
    d = spark.createDataFrame(rows, "frame long, seed_x double, seed_y double, centre_x double, centre_y double, radius double, x double, y double, confidence double, visible boolean").repartition(3)
    got = {r.frame: r for r in lenses.group_centres(d, ("frame",), 640.0, 480.0).collect()}
    true = np.array([1.0, 2.0]) @ np.array([[0, 1.5], [-1.5, 0]]) + [100, 80]
    assert (got[0].x, got[0].y) == pytest.approx(tuple(true)) and got[0].confidence == pytest.approx(0.9) and got[0].visible
    assert (got[1].x, got[1].y) == pytest.approx(tuple(true), abs=1.5) and got[1].confidence < 0.9
    move = np.median(seed * 4 + 300, axis=0)
    assert (got[2].x, got[2].y) == pytest.approx((1 + move[0], 2 + move[1])) and got[2].confidence == pytest.approx(0.54)
    assert (got[3].x, got[3].y) == pytest.approx((48, 39)) and got[3].confidence == pytest.approx(0.54)
    assert got[4].x is None and got[4].confidence == 0 and not got[4].visible
    assert (got[5].x, got[5].y) == pytest.approx(tuple(true)) and got[5].confidence == pytest.approx(0.45) and not got[5].visible


def test_quadratics_side_by_side_equal_single_ones_and_pixels_meet_only_points_that_reach(spark):
    from motionframe.operators import lenses

    rng = np.random.default_rng(3)
    p, to = rng.normal(0, 250, (40, 12, 2)), rng.normal(0, 100, (40, 12, 2))
    p[1] = p[1, :1]  # equal places have the fit of least norm
    got = lenses.quadratics(p, to)
    for i in range(40):
        want = np.linalg.lstsq(np.column_stack([np.ones(12), p[i, :, 0], p[i, :, 1], p[i].prod(1), p[i, :, 0] ** 2, p[i, :, 1] ** 2]), to[i], rcond=None)[0]
        assert np.allclose(got[i], want, rtol=1e-7, atol=1e-9)
    rows = [("a", *map(float, x), 1.0, 2.0) for x in rng.normal(0, 50, (60, 2))]
    points = spark.createDataFrame(rows, "lens string, x double, y double, to_x double, to_y double")
    plan = lenses.mapped(points.select("lens", "x", "y"), lenses.fitted(points), ("x", "y"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(HYPOT(" in plan.split("Join LeftOuter, ", 1)[1].split("\n")[0]
