"""Visual hulls: voxels voted on by cameras, their measures, and mesh sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.functions.scalars import dlt_project


def bounds(points: DataFrame, margin: float) -> DataFrame:
    """Axis-aligned box of the solved points with a margin of their extent."""
    sides = []
    for c in "xyz":
        pad = margin * (F.max(c) - F.min(c))
        sides += [(F.min(c) - pad).alias(f"{c}0"), (F.max(c) + pad).alias(f"{c}1")]
    return points.agg(*sides)


def voxels(spark: SparkSession, lo: tuple[float, float, float], n: tuple[int, int, int], size: float) -> DataFrame:
    """(ix, iy, iz, x, y, z) of a regular grid; made where it is used, from one range."""
    d = spark.range(n[0] * n[1] * n[2])
    i = {"ix": F.col("id") % n[0], "iy": F.floor(F.col("id") / n[0]) % n[1], "iz": F.floor(F.col("id") / (n[0] * n[1]))}
    d = d.select(*(c.cast("long").alias(k) for k, c in i.items()))
    return d.withColumns({a: F.lit(lo[k]) + (F.col(f"i{a}") + 0.5) * size for k, a in enumerate("xyz")})


def votes(grid: DataFrame, cameras: DataFrame, masks: DataFrame, width: int, height: int) -> DataFrame:
    """(ix, iy, iz, x, y, z, inside, seen): cameras whose mask holds the voxel, and cameras whose picture does.

    ``masks`` (cam, u0, u1, v0, v1) are boxes of whole pixels, one a camera; both dimensions are small.
    """
    d = grid.crossJoin(F.broadcast(cameras.join(masks, "cam")))
    u, v = dlt_project([F.get("coefs", F.lit(i)) for i in range(11)], F.col("x"), F.col("y"), F.col("z"))
    d = d.withColumns({"pu": F.floor(u + 0.5), "pv": F.floor(v + 0.5)})
    on = (F.col("pu") >= 0) & (F.col("pu") < width) & (F.col("pv") >= 0) & (F.col("pv") < height)
    held = on & F.col("pu").between(F.col("u0"), F.col("u1")) & F.col("pv").between(F.col("v0"), F.col("v1"))
    return d.groupBy("ix", "iy", "iz", "x", "y", "z").agg(F.count_if(held).alias("inside"), F.count_if(on).alias("seen"))


def carved(voted: DataFrame, least: int, tolerance: int = 0) -> DataFrame:
    return voted.where((F.col("inside") >= least) & (F.col("inside") >= F.col("seen") - tolerance) & (F.col("seen") > 0))


def measures(solid: DataFrame, size: float) -> DataFrame:
    """Volume, centroid, extent and the share of voxels that fewer than three cameras see."""
    ends = [f(c).alias(f"{c}_{k}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))]
    return solid.agg((F.count("*") * size**3).alias("volume"), *(F.avg(c).alias(f"{c}_mean") for c in "xyz"), *ends, F.avg((F.col("seen") < 3).cast("double")).alias("thin"))


def mesh_volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Signed volume of a closed mesh: (i, x, y, z) and (a, b, c)."""
    d = faces
    for k in "abc":
        d = d.join(vertices.select(F.col("i").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), k)
    p = lambda k: [F.col(f"{k}{c}") for c in "xyz"]
    a, b, c = p("a"), p("b"), p("c")
    triple = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return d.agg((F.sum(triple) / 6).alias("volume"))


def smoothed_mesh(vertices: DataFrame, faces: DataFrame, steps: int, share: float) -> DataFrame:
    """Each step moves every vertex a share of the way to the mean of its neighbours."""
    pairs = F.array(*(F.struct(F.col(x).alias("i"), F.col(y).alias("j")) for x in "abc" for y in "abc" if x != y))
    edges = faces.select(F.inline(pairs)).distinct()
    for _ in range(steps):
        near = edges.join(vertices.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        vertices = vertices.join(near, "i", "left").select("i", *((F.col(c) + share * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"))
    return vertices
