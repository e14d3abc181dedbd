"""Registered queries over hulls: an ellipsoid as wide as the data, carved from its silhouettes in eight cameras, and its surface."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.operators import hull, surface
from motionframe.plans.adapter import read
from motionframe.plans.motion import query

#: A ring of cameras: picture, focal length, distance; voxels along each side of the box.
WIDTH, HEIGHT, FOCAL, AWAY, SIDE = 640, 480, 500.0, 2.0, 40


def _axes(spark: SparkSession, sf: str) -> tuple[float, float, float]:
    """Two deviations of the first three components over all vectors, the half axes of the ellipsoid: three numbers."""
    return tuple(read(spark, sf, "embeddings").agg(*(2 * F.stddev_pop(F.get("embedding", F.lit(i)).cast("double")) for i in range(3))).first())


def _ring() -> list[np.ndarray]:
    """Eight 3x4 matrices that look at the origin from different heights, scaled so that the last number is 1."""
    out = []
    for k in range(8):
        turn, rise = 2 * math.pi * k / 8, (-0.9, 0.2, 0.9, -0.3)[k % 4]
        at = AWAY * np.array([math.cos(turn) * math.cos(rise), math.sin(turn) * math.cos(rise), math.sin(rise)])
        z = -at / np.linalg.norm(at)
        x = np.cross(z, [0.0, 0.0, 1.0])
        x /= np.linalg.norm(x)
        r = np.stack([x, np.cross(z, x), z])
        m = np.array([[FOCAL, 0, WIDTH / 2], [0, FOCAL, HEIGHT / 2], [0, 0, 1]]) @ np.column_stack([r, -r @ at])
        out.append(m / m[2, 3])
    return out


def silhouettes(spark: SparkSession, axes: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Cameras, and runs of the ellipsoid's silhouettes: an ellipse in each picture, so a run a row."""
    cams, conics = [], []
    for c, m in enumerate(_ring()):
        cams.append((c, [float(x) for x in m.ravel()[:11]], WIDTH, HEIGHT))
        k = np.linalg.inv(m @ np.diag([a * a for a in axes] + [-1.0]) @ m.T)
        conics.append((c, *map(float, (k[0, 0], k[0, 1], k[1, 1], k[0, 2], k[1, 2], k[2, 2]))))
    q = spark.createDataFrame(conics, "cam int, a double, b double, c double, d double, e double, f double").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
    # a u^2 + 2 (b v + d) u + (c v^2 + 2 e v + f) = 0 at the silhouette's border.
    v = F.col("row").cast("double")
    h, g = F.col("b") * v + F.col("d"), F.col("c") * v * v + 2 * F.col("e") * v + F.col("f")
    q = q.withColumns({"mid": -h / F.col("a"), "half": F.sqrt(h * h - F.col("a") * g) / F.abs("a")}).where("half is not null and not isnan(half)")
    runs = q.select("cam", "row", F.greatest(F.ceil(F.col("mid") - F.col("half")), F.lit(0)).alias("u0"), F.least(F.floor(F.col("mid") + F.col("half")), F.lit(WIDTH - 1)).alias("u1")).where("u0 <= u1")
    return spark.createDataFrame(cams, "cam int, coefs array<double>, width int, height int"), runs


def _solid(spark: SparkSession, sf: str) -> tuple[DataFrame, tuple[float, float, float], float]:
    axes = _axes(spark, sf)
    size = 2.4 * max(axes) / SIDE
    cams, runs = silhouettes(spark, axes)
    lo = tuple(-size * SIDE / 2 for _ in range(3))
    return hull.carved(surface.run_votes(hull.voxels(spark, lo, (SIDE,) * 3, size), cams, runs), 2), axes, size


@query("WITH s AS (SELECT 2 * stddev_pop(CAST(embedding[1] AS DOUBLE)) AS a, 2 * stddev_pop(CAST(embedding[2] AS DOUBLE)) AS b, 2 * stddev_pop(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings) SELECT true AS hull_holds, true AS surface_near, round(4 / 3.0 * pi() * a * b * c, 6) AS volume FROM s")
def ellipsoid_hull(spark, sf):
    """An ellipsoid carved from its silhouettes: the hull holds it and is at most 1.6 times as large, its blurred surface is within 8 %."""
    solid, axes, size = _solid(spark, sf)
    solid = solid.persist()
    true = 4 / 3 * math.pi * axes[0] * axes[1] * axes[2]
    field = surface.blurred(surface.signed_distance(solid, (SIDE,) * 3), 1.0)
    mesh = surface.enclosed(surface.surface(field), size)
    both = hull.measures(solid, size).select(F.col("volume").alias("hull")).join(mesh.select(F.col("volume").alias("mesh")))
    return both.select(F.col("hull").between(0.95 * true, 1.6 * true).alias("hull_holds"), (F.abs(F.col("mesh") - true) <= 0.08 * true).alias("surface_near"), F.round(F.lit(true), 6).alias("volume"))
