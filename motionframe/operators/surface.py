"""Surfaces of visual hulls: votes by silhouettes stored as runs, distance fields by sweeps over slabs, marching tetrahedra.

A field is a table (ix, iy, iz, value) of a box of whole positions. Separable sweeps (exact squared distances,
Gaussian blur) need the values of a line; lines travel as slabs, two axes at a time, so a field is shuffled twice a
sweep over all three axes, and a group holds one plane of the box.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.functions.scalars import dlt_project, let

AXES = ("ix", "iy", "iz")
FAR = 1e12
#: The six tetrahedra of a cube that share the diagonal from its first to its last corner: each goes there along the axes in another order.
TETRAHEDRA = tuple((0, 1 << a, 1 << a | 1 << b, 7) for a in range(3) for b in range(3) if a != b)
#: Vertices of a surface are welded on a grid of so many parts of a voxel.
WELD = 1024


def run_votes(grid: DataFrame, cameras: DataFrame, runs: DataFrame) -> DataFrame:
    """(ix, iy, iz, x, y, z, inside, seen): cameras whose silhouette holds a voxel, and cameras that have a say on it.

    ``runs`` (cam, row, u0, u1) are the silhouettes' runs of pixels, ``cameras`` (cam, coefs, width, height) a
    handful. A camera without a silhouette has no say. One whose silhouette stays off the border sees the whole
    object, so what lies outside its picture is outside its silhouette.
    """
    edge = F.min("u0") <= 0
    touch = runs.join(F.broadcast(cameras.select("cam", "width", "height")), "cam").groupBy("cam").agg((edge | (F.max(F.col("u1") - F.col("width") + 1) >= 0) | (F.min("row") <= 0) | (F.max(F.col("row") - F.col("height") + 1) >= 0)).alias("cut"))
    d = grid.crossJoin(F.broadcast(cameras.join(touch, "cam")))
    u, v = dlt_project([F.get("coefs", F.lit(i)) for i in range(11)], F.col("x"), F.col("y"), F.col("z"))
    d = d.withColumns({"u": F.floor(u + 0.5), "row": F.floor(v + 0.5)})
    on = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("row") >= 0) & (F.col("row") < F.col("height"))
    d = d.select(*AXES, "x", "y", "z", "cam", "u", "row", on.alias("on"), "cut")
    held = d.where("on").join(runs, ["cam", "row"]).where("u between u0 and u1").groupBy(*AXES).agg(F.countDistinct("cam").alias("inside"))
    seen = d.groupBy(*AXES, "x", "y", "z").agg(F.count_if(F.col("on") | ~F.col("cut")).alias("seen"))
    return seen.join(held, list(AXES), "left").select(*AXES, "x", "y", "z", F.coalesce("inside", F.lit(0)).alias("inside"), "seen")


def _swept(field: DataFrame, sweep: Callable[[np.ndarray, int], np.ndarray], columns: tuple[str, ...]) -> DataFrame:
    """``sweep(values, axis)`` along all three axes of each column: planes of equal iz first, then planes of equal ix for the axis left."""

    def plane(fixed: str, axes: tuple[str, str], which: tuple[int, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(list(axes))
            shape = tuple(f[a].nunique() for a in axes)
            for c in columns:
                v = f[c].to_numpy().reshape(shape)
                for axis in which:
                    v = sweep(v, axis)
                f[c] = v.ravel()
            return f

        return run

    schema = field.schema
    first = field.groupBy("iz").applyInPandas(plane("iz", ("ix", "iy"), (0, 1)), schema)
    return first.groupBy("ix").applyInPandas(plane("ix", ("iy", "iz"), (1,)), schema)


def _nearest(v: np.ndarray, axis: int) -> np.ndarray:
    """The least of value plus squared distance along an axis."""
    v = np.moveaxis(v, axis, 0)
    out, at = np.empty_like(v), np.arange(len(v))
    for i in range(len(v)):
        out[i] = (v + ((at - i) ** 2)[:, None]).min(0)
    return np.moveaxis(out, 0, axis)


def _blurred(sigma: float) -> Callable[[np.ndarray, int], np.ndarray]:
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()

    def run(v: np.ndarray, axis: int) -> np.ndarray:
        v = np.moveaxis(v, axis, 0)
        padded = np.pad(v, ((reach, reach), (0, 0)), mode="symmetric")
        return np.moveaxis(sum(k * padded[i : i + len(v)] for i, k in enumerate(w)), 0, axis)

    return run


def signed_distance(solid: DataFrame, n: tuple[int, int, int]) -> DataFrame:
    """(ix, iy, iz, value): distances in voxels, positive inside, of a box of ``n`` voxels padded by an empty one on all sides.

    ``solid`` (ix, iy, iz) are the voxels inside. Without any, every value is -1.
    """
    spark = solid.sparkSession
    size = [k + 2 for k in n]
    box = spark.range(size[0] * size[1] * size[2]).select((F.col("id") % size[0] - 1).alias("ix"), (F.floor(F.col("id") / size[0]) % size[1] - 1).alias("iy"), (F.floor(F.col("id") / (size[0] * size[1])) - 1).alias("iz"))
    box = box.join(solid.select(*(F.col(a).cast("long").alias(a) for a in AXES), F.lit(True).alias("in")).distinct(), list(AXES), "left")
    field = box.select(*AXES, F.when(F.col("in"), 0.0).otherwise(FAR).alias("to_in"), F.when(F.col("in"), FAR).otherwise(0.0).alias("to_out"))
    got = _swept(field, _nearest, ("to_in", "to_out"))
    return got.select(*AXES, F.when(F.col("to_in") >= FAR, -1.0).otherwise(F.sqrt("to_out") - F.sqrt("to_in")).alias("value"))


def blurred(field: DataFrame, sigma: float) -> DataFrame:
    """The field under a Gaussian of ``sigma`` voxels, mirrored at its sides."""
    return _swept(field, _blurred(sigma), ("value",)) if sigma > 0 else field


def surface(field: DataFrame, iso: float = 0.0) -> DataFrame:
    """(a, b, c) triangles, arrays of x, y, z in voxels, that face out of where the field is over ``iso``.

    Every position gives its value to the eight cells it is a corner of; a cell with all its corners makes the
    triangles of its six tetrahedra.
    """
    corners = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *((F.col(a) - (k >> i & 1)).alias(f"c{a}") for i, a in enumerate(AXES))) for k in range(8))))
    cells = field.select("value", corners.alias("c")).groupBy("c.cix", "c.ciy", "c.ciz").agg(F.transform(F.sort_array(F.collect_list(F.struct("c.k", "value"))), lambda x: x["value"]).alias("v"))
    cells = cells.where((F.size("v") == 8) & (F.array_min("v") <= iso) & (F.array_max("v") > iso))

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            v, base = np.stack(f["v"].to_numpy()), f[["cix", "ciy", "ciz"]].to_numpy(float)
            made = [triangles(v[:, tet], base[:, None, :] + np.array([[k >> i & 1 for i in range(3)] for k in tet]), iso) for tet in TETRAHEDRA]
            t = np.concatenate(made)
            yield pd.DataFrame({"a": list(t[:, 0]), "b": list(t[:, 1]), "c": list(t[:, 2])})

    return cells.mapInPandas(run, "a array<double>, b array<double>, c array<double>")


def triangles(v: np.ndarray, p: np.ndarray, iso: float) -> np.ndarray:
    """(triangles, 3, 3) of tetrahedra with values (n, 4) at corners (n, 4, 3).

    Sorted by value, the corners over ``iso`` are the last one, two or three. One corner on its side is cut off
    by a triangle; two are by a quadrangle, which is two triangles.
    """
    order = np.argsort(v, 1, kind="stable")
    v, p = np.take_along_axis(v, order, 1), np.take_along_axis(p, order[:, :, None], 1)
    over = (v > iso).sum(1)

    def cut(rows: np.ndarray, i: int, j: int) -> np.ndarray:
        share = (iso - v[rows, i]) / np.maximum(v[rows, j] - v[rows, i], 1e-12)
        return p[rows, i] + np.clip(share, 0, 1)[:, None] * (p[rows, j] - p[rows, i])

    out = [np.zeros((0, 3, 3))]
    for n, faces in ((1, [((0, 3), (1, 3), (2, 3))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))]), (3, [((0, 1), (0, 2), (0, 3))])):
        rows = np.flatnonzero(over == n)
        middle = p[rows, 4 - n :].mean(1) if len(rows) else np.zeros((0, 3))
        for face in faces:
            t = np.stack([cut(rows, *e) for e in face], 1) if len(rows) else np.zeros((0, 3, 3))
            inward = np.einsum("ij,ij->i", np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), middle - t.mean(1)) > 0
            t[inward] = t[inward][:, ::-1]
            out.append(t)
    return np.concatenate(out)


def welded(soup: DataFrame, origin: tuple[float, float, float], size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices (i, x, y, z) in world units and faces (a, b, c) of triangles in voxels; corners closer than a weld are one, triangles without three drop.

    A vertex is named by its place, so that faces need no numbering of vertices.
    """
    key = lambda c: F.transform(F.col(c), lambda x: F.round(x * WELD).cast("long"))
    faces = soup.select(*(F.array_join(key(c).cast("array<string>"), " ").alias(c) for c in "abc")).where("a <> b AND b <> c AND a <> c")
    names = faces.select(F.explode(F.array("a", "b", "c")).alias("i")).distinct()
    at = F.split("i", " ")
    return names.select("i", *((F.get(at, F.lit(k)).cast("double") / WELD * size + origin[k]).alias(a) for k, a in enumerate("xyz"))), faces


def enclosed(soup: DataFrame, size: float) -> DataFrame:
    """The volume that triangles in voxels enclose."""
    part = lambda t: (F.get(t["a"], F.lit(0)) * (F.get(t["b"], F.lit(1)) * F.get(t["c"], F.lit(2)) - F.get(t["b"], F.lit(2)) * F.get(t["c"], F.lit(1)))
                      + F.get(t["a"], F.lit(1)) * (F.get(t["b"], F.lit(2)) * F.get(t["c"], F.lit(0)) - F.get(t["b"], F.lit(0)) * F.get(t["c"], F.lit(2)))
                      + F.get(t["a"], F.lit(2)) * (F.get(t["b"], F.lit(0)) * F.get(t["c"], F.lit(1)) - F.get(t["b"], F.lit(1)) * F.get(t["c"], F.lit(0))))
    return soup.agg((F.abs(F.sum(let(F.struct("a", "b", "c"), part))) / 6 * size**3).alias("volume"))
