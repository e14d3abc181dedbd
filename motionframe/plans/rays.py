"""Registered queries over viewing rays: epipolar segments and the targets that other cameras' rays give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from motionframe.operators import epipolar, lenses
from motionframe.plans.adapter import DLT, DLT_SQL, OBSERVED, calibration, observations, read, with_
from motionframe.plans.motion import query

_CENTRES = [np.linalg.solve([[*k[0:3]], [*k[4:7]], [*k[8:11]]], [-k[3], -k[7], -1.0]) for k in DLT]
_CENTRE_SQL = "centre(cam, cx, cy, cz) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"{float(x)!r}::DOUBLE" for x in c) + ")" for i, c in enumerate(_CENTRES)) + ")"
#: The ray's image in the other camera, clipped by five half planes; the world's origin is in front of all cameras.
_LINES_SQL = """ray AS (SELECT name, frame, cam, u, v, (l2-u*l10)*(l7-v*l11) - (l3-u*l11)*(l6-v*l10) AS x, (l3-u*l11)*(l5-v*l9) - (l1-u*l9)*(l7-v*l11) AS y, (l1-u*l9)*(l6-v*l10) - (l2-u*l10)*(l5-v*l9) AS z, l9, l10, l11 FROM observed JOIN dlt USING (cam)),
    dir AS (SELECT name, frame, cam, u, v, x * sign(l9*x+l10*y+l11*z) / sqrt(x*x+y*y+z*z) AS x, y * sign(l9*x+l10*y+l11*z) / sqrt(x*x+y*y+z*z) AS y, z * sign(l9*x+l10*y+l11*z) / sqrt(x*x+y*y+z*z) AS z FROM ray),
    hom AS (SELECT r.name, r.frame, r.cam, d.cam AS dst, l1*cx+l2*cy+l3*cz+l4 AS c0, l5*cx+l6*cy+l7*cz+l8 AS c1, l9*cx+l10*cy+l11*cz+1 AS c2, l1*x+l2*y+l3*z AS r0, l5*x+l6*y+l7*z AS r1, l9*x+l10*y+l11*z AS r2 FROM dir r JOIN centre USING (cam) JOIN dlt d ON d.cam <> r.cam),
    cond AS (SELECT *, unnest([{'a': c2, 'b': r2}, {'a': c0 + 320.5*c2, 'b': r0 + 320.5*r2}, {'a': 1599.5*c2 - c0, 'b': 1599.5*r2 - r0}, {'a': c1 + 180.5*c2, 'b': r1 + 180.5*r2}, {'a': 899.5*c2 - c1, 'b': 899.5*r2 - r1}]) AS h FROM hom),
    cut AS (SELECT name, frame, cam, dst, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, any_value(r0) AS r0, any_value(r1) AS r1, any_value(r2) AS r2, greatest(max(CASE WHEN h.b > 0 THEN -h.a / h.b END), 0) AS lo, min(CASE WHEN h.b < 0 THEN -h.a / h.b END) AS hi FROM cond GROUP BY name, frame, cam, dst),
    seg AS (SELECT name, frame, cam, dst, (c0 + lo*r0) / (c2 + lo*r2) AS x0, (c1 + lo*r1) / (c2 + lo*r2) AS y0, CASE WHEN hi IS NULL THEN r0 / r2 ELSE (c0 + hi*r0) / (c2 + hi*r2) END AS x1, CASE WHEN hi IS NULL THEN r1 / r2 ELSE (c1 + hi*r1) / (c2 + hi*r2) END AS y1 FROM cut WHERE hi IS NULL OR lo < hi)"""


def _cameras(spark):
    return calibration(spark).withColumns({"width": F.lit(1280), "height": F.lit(720)})


@query(with_(OBSERVED, DLT_SQL, _CENTRE_SQL, _LINES_SQL) + "SELECT name, frame, CAST(cam AS INTEGER) AS cam, CAST(dst AS INTEGER) AS dst, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM seg")
def epipolar_segments(spark, sf):
    d = epipolar.pair_segments(observations(spark, sf), _cameras(spark))
    end = lambda i, c, n: F.round(F.get("segment", F.lit(i))[c], 4).alias(n)
    return d.select("name", "frame", "cam", "dst", end(0, "x", "x0"), end(0, "y", "y0"), end(1, "x", "x1"), end(1, "y", "y1"))


@query(with_(OBSERVED, DLT_SQL, _CENTRE_SQL, _LINES_SQL) + """, near AS (SELECT s.*, coalesce(o.u, 640) AS px, coalesce(o.v, 360) AS py, -(y1-y0) / sqrt(pow(x1-x0, 2) + pow(y1-y0, 2)) AS a, (x1-x0) / sqrt(pow(x1-x0, 2) + pow(y1-y0, 2)) AS b FROM seg s LEFT JOIN observed o ON o.name = s.name AND o.frame = s.frame AND o.cam = s.dst),
    foot AS (SELECT *, least(greatest(((px-x0)*(x1-x0) + (py-y0)*(y1-y0)) / (pow(x1-x0, 2) + pow(y1-y0, 2)), 0), 1) AS t FROM near),
    pair AS (SELECT p.name, p.frame, p.dst, min(abs(p.a*q.a + p.b*q.b)) AS c FROM foot p JOIN foot q ON q.name = p.name AND q.frame = p.frame AND q.dst = p.dst GROUP BY ALL),
    fit AS (SELECT f.name, f.frame, f.dst, count(*) AS n, any_value(c) AS c, avg(x0 + t*(x1-x0)) AS fx, avg(y0 + t*(y1-y0)) AS fy, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*(a*x0+b*y0)) AS ac, sum(b*(a*x0+b*y0)) AS bc FROM foot f JOIN pair USING (name, frame, dst) GROUP BY f.name, f.frame, f.dst),
    pt AS (SELECT *, CASE WHEN n = 1 THEN 'one' WHEN degrees(acos(least(c, 1))) < 5 THEN 'parallel' ELSE 'crossing' END AS mode FROM fit),
    xy AS (SELECT *, CASE WHEN mode = 'crossing' THEN (ac*bb - bc*ab) / (aa*bb - ab*ab) ELSE fx END AS x, CASE WHEN mode = 'crossing' THEN (aa*bc - ab*ac) / (aa*bb - ab*ab) ELSE fy END AS y FROM pt),
    gap AS (SELECT *, sqrt(pow(greatest(-0.5 - x, x - 1279.5, 0), 2) + pow(greatest(-0.5 - y, y - 719.5, 0), 2)) AS off FROM xy)
    SELECT name, frame, CAST(dst AS INTEGER) AS cam, mode, CAST(n AS INTEGER) AS lines, round(CASE WHEN off <= 6.4 THEN CASE WHEN x < -0.5 THEN 0 WHEN x >= 1279.5 THEN 1279 ELSE x END END, 3) AS x, round(CASE WHEN off <= 6.4 THEN CASE WHEN y < -0.5 THEN 0 WHEN y >= 719.5 THEN 719 ELSE y END END, 3) AS y, round(off, 3) AS outside FROM gap""")
def ray_targets(spark, sf):
    """Where the rays of the other cameras put each observed landmark, also in cameras that don't see it."""
    d = epipolar.ray_targets(observations(spark, sf), _cameras(spark))
    return d.select("name", "frame", "cam", "mode", "lines", *(F.round(c, 3).alias(c) for c in ("x", "y", "outside")))


# ---- lenses and constellations -----------------------------------------------------------------------------------

_CONTROL = """ctl AS (SELECT label AS lens, vec_id, 2000 * e[1] AS x, 2000 * e[2] AS y, 1000 * e[3] AS qx, 1000 * e[4] AS qy FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
    gap AS (SELECT a.lens, a.vec_id, a.x, a.y, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.lens, a.vec_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS k FROM ctl a JOIN ctl b ON a.lens = b.lens),
    reach AS (SELECT lens, x, y, d FROM gap WHERE k = 12)"""


@query("WITH " + _CONTROL + """ SELECT lens, vec_id, round(CASE WHEN hit THEN qx * 0.9 + 3e-5 * qx * qy + 10 END, 3) AS x, round(CASE WHEN hit THEN qy * 1.1 - 2e-5 * qx * qx END, 3) AS y
    FROM (SELECT q.*, EXISTS (SELECT 1 FROM reach r WHERE r.lens = q.lens AND sqrt(pow(q.qx - r.x, 2) + pow(q.qy - r.y, 2)) < r.d) AS hit FROM ctl q)""")
def lens_maps(spark, sf):
    """Pixels through lenses whose control points follow a quadratic, which local quadratics then give back wherever one reaches."""
    at = lambda i, k: k * F.get("embedding", F.lit(i)).cast("double")
    e = read(spark, sf, "embeddings").select(F.col("label").alias("lens"), "vec_id", at(0, 2000).alias("x"), at(1, 2000).alias("y"), at(2, 1000).alias("qx"), at(3, 1000).alias("qy"))
    x, y = F.col("x"), F.col("y")
    points = e.select("lens", "x", "y", (x * 0.9 + 3e-5 * x * y + 10).alias("to_x"), (y * 1.1 - 2e-5 * x * x).alias("to_y"))
    got = lenses.mapped(e.select("lens", "vec_id", F.col("qx").alias("x"), F.col("qy").alias("y")), lenses.fitted(points), ("vec_id",))
    return got.select("lens", "vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_MEMBERS = """mem AS (SELECT vec_id, m, 40 * e[1 + 2*m] AS sx, 40 * e[2 + 2*m] AS sy, e[40] AS turn, 1 + e[41] AS scale FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), (SELECT unnest(range(0, 12)) AS m))"""


@query("WITH " + _MEMBERS + " SELECT vec_id, round(320 + 5 * scale * cos(turn), 3) AS x, round(240 + 5 * scale * sin(turn), 3) AS y, true AS visible, round(9 / 12.0 * 0.8, 6) AS confidence FROM mem WHERE m = 0")
def constellation_centres(spark, sf):
    """Groups of twelve members that turn, grow and move; three of each follow something else. The oracle is the motion they were made with."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    at = lambda i: F.get("e", i)
    sx, sy, turn, scale = 40 * at(2 * F.col("m")), 40 * at(2 * F.col("m") + 1), at(F.lit(39)), 1 + at(F.lit(40))
    off = F.when(F.col("m") % 4 == 3, 60.0 + 20 * F.col("m")).otherwise(0.0)
    x, y = 320 + scale * (F.cos(turn) * sx - F.sin(turn) * sy) + off, 240 + scale * (F.sin(turn) * sx + F.cos(turn) * sy) - off / 2
    d = e.select("vec_id", sx.alias("seed_x"), sy.alias("seed_y"), F.lit(5.0).alias("centre_x"), F.lit(0.0).alias("centre_y"), F.lit(10.0).alias("radius"), x.alias("x"), y.alias("y"), F.lit(0.8).alias("confidence"), F.lit(True).alias("visible"))
    return lenses.group_centres(d, ("vec_id",), 640.0, 480.0).select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "visible", F.round("confidence", 6).alias("confidence"))
