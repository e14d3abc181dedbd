"""Lenses given by matched control points: locally weighted quadratic maps.

Around each control point a quadratic is fitted to its nearest ones, and has a say as far as the farthest of
them. A pixel's value is the weighted mean of the quadratics that reach it. Pixels meet control points by nested
grids, one for each power of two among a lens's reaches: a control point is copied to the cells of its own grid
that its circle touches, nine or so, a pixel is in one cell of each grid, and the join is by lens, grid and cell.
A cell so holds few points whose circles miss it, however unevenly a lens's points lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control points of a fit, and the fewest a lens needs.
NEIGHBOURS, LEAST_POINTS = 12, 6
#: Control points of a cell, and distances at a time, in the search for nearest ones.
CELL_POINTS, AT_ONCE = 32, 1 << 20
#: Quadratics fitted side by side.
FITS = 4096


def _terms(x, y):
    return [1.0 + 0 * x, x, y, x * y, x * x, y * y]


def nearest(p: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): positions of the ``k`` nearest of ``p`` to each of them, itself included, the first of equally near ones.

    ``p`` is sorted, so equal places follow each other. Each place looks in its cell of a grid and the eight around
    it, which hold all that is nearer than a cell is wide; where that is too little, in a grid twice as wide.
    """
    new = np.append(True, (p[1:] != p[:-1]).any(1))
    asks, place = np.flatnonzero(new), np.cumsum(new) - 1
    pool = np.flatnonzero(np.arange(len(p)) - asks[place] < k)  # later ones of a place never count
    low = p.min(0)
    extent = float((p.max(0) - low).max())
    size = 2 * extent / len(asks) ** 0.5 or 1.0
    at = lambda i: np.floor((p[i] - low) / size).astype(np.int64)
    while size > extent / 2**28 and np.unique(at(asks), axis=0, return_counts=True)[1].max() > CELL_POINTS:
        size /= 2
    out, open_ = np.empty((len(asks), k), np.int64), np.arange(len(asks))
    while len(open_):
        high = int(extent / size) + 3
        number = lambda g: (g[:, 0] + 1) * high + g[:, 1] + 1
        cells = number(at(pool))
        order = np.argsort(cells, kind="stable")
        cells, own = cells[order], number(at(asks[open_]))
        mine = np.argsort(own, kind="stable")
        bounds = np.flatnonzero(np.append(True, own[mine][1:] != own[mine][:-1])).tolist() + [len(mine)]
        left = []
        for s, e in zip(bounds, bounds[1:], strict=False):
            c = own[mine[s]]
            spans = np.searchsorted(cells, [c - high - 1, c - high + 2, c - 1, c + 2, c + high - 1, c + high + 2])
            near = np.sort(pool[np.concatenate([order[spans[i] : spans[i + 1]] for i in (0, 2, 4)])])
            step = max(1, AT_ONCE // max(len(near), 1))
            for lo in range(s, e, step):
                who = open_[mine[lo : min(lo + step, e)]]
                if len(near) < k:
                    left.append(who)
                    continue
                d = np.linalg.norm(p[asks[who], None] - p[near][None], axis=2)
                first = np.argsort(d, 1, kind="stable")[:, :k]
                done = (np.take_along_axis(d, first[:, -1:], 1)[:, 0] < size * (1 - 1e-9)) | (size >= 2 * extent)
                out[who[done]] = near[first[done]]
                left.append(who[~done])
        open_ = np.sort(np.concatenate(left))
        size *= 2
    return out[place]


def quadratics(p: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(fits, 6, 2): least-squares coefficients of least norm for (fits, points, 2) places and values."""
    u, s, vt = np.linalg.svd(np.stack(_terms(p[..., 0], p[..., 1]), 2), full_matrices=False)
    some = s > np.finfo(float).eps * max(p.shape[1], 6) * s[:, :1]
    part = np.swapaxes(u, 1, 2) @ to * np.where(some, 1 / np.where(some, s, 1.0), 0.0)[..., None]
    return np.swapaxes(vt, 1, 2) @ part


def _parts(d: DataFrame) -> int:
    return int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fitted(points: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(lens, x, y, reach, cx, cy) of each control point of (lens, x, y, to_x, to_y): its place, how far it reaches, the coefficients of both coordinates.

    A lens is a group, and takes time in proportion to its control points. Points with a value that is missing or
    not finite don't count. Lenses with fewer than six points have no map.
    """
    values = ("x", "y", "to_x", "to_y")
    points = points.where(" AND ".join(f"abs({c}) < double('Infinity')" for c in values))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(list(values))
        p, to = f[["x", "y"]].to_numpy(float), f[["to_x", "to_y"]].to_numpy(float)
        if len(p) < LEAST_POINTS:
            return pd.DataFrame([], columns=["lens", "x", "y", "reach", "cx", "cy"])
        near = nearest(p, min(max(neighbours, LEAST_POINTS), len(p)))
        reach = np.maximum(np.linalg.norm(p[:, None] - p[near], axis=2).max(1), 1e-9)
        c = np.concatenate([quadratics(p[near[lo : lo + FITS]], to[near[lo : lo + FITS]]) for lo in range(0, len(p), FITS)])
        return pd.DataFrame({"lens": key[0], "x": p[:, 0], "y": p[:, 1], "reach": reach, "cx": list(c[:, :, 0]), "cy": list(c[:, :, 1])})

    kind = points.schema["lens"].dataType.simpleString()
    # As many partitions as the session asks for: few bytes are much work here, by which adaptive plans would put all lenses in one task.
    return points.repartition(_parts(points), "lens").groupBy("lens").applyInPandas(one, f"lens {kind}, x double, y double, reach double, cx array<double>, cy array<double>")


def mapped(pixels: DataFrame, fits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, lens, x, y) of ``pixels`` (keys, lens, x, y) through their lens's map; NULL where no control point reaches. ``keys`` tell pixels apart."""
    fits = fits.select("lens", F.col("x").alias("px"), F.col("y").alias("py"), "reach", "cx", "cy", F.ceil(F.log2("reach")).cast("int").alias("grid"))
    size = F.pow(F.lit(2.0), F.col("grid"))
    cells = lambda c: F.sequence(F.floor((F.col(c) - F.col("reach")) / size), F.floor((F.col(c) + F.col("reach")) / size))
    spread = fits.withColumn("gx", F.explode(cells("px"))).withColumn("gy", F.explode(cells("py")))
    grids = fits.groupBy("lens").agg(F.collect_set("grid").alias("grids"))
    own = pixels.select(*keys, "lens", "x", "y").join(grids, "lens", "left").withColumn("grid", F.explode_outer("grids")).drop("grids")
    own = own.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)})
    cell = ["lens", "grid", "gx", "gy"]
    r = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) / F.col("reach")
    # Points of a cell whose circles miss the pixel go in the join itself; a pixel that none reaches stays.
    at = spread.select(*(F.col(c).alias(f"_{c}") for c in cell), "px", "py", "reach", "cx", "cy").repartition(_parts(pixels), *(f"_{c}" for c in cell))
    meets = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in cell))
    d = own.repartition(_parts(pixels), *cell).join(at, meets & (r < 1), "left").withColumn("w", 1 - 3 * r * r + 2 * r * r * r)
    value = lambda c: sum((F.get(c, F.lit(i)) * t for i, t in enumerate(_terms(F.col("x"), F.col("y")))), F.lit(0.0))
    mean = lambda c: F.try_divide(F.sum(F.col("w") * value(c)), F.sum("w"))
    return d.groupBy(*keys, "lens").agg(mean("cx").alias("x"), mean("cy").alias("y"))


# ---- constellations of members -----------------------------------------------------------------------------------

#: Members a similarity must fit, the least radius of a group that is fitted, limits of its scale, confidence of a mere displacement.
LEAST_FIT, LEAST_RADIUS, SCALES, LOOSE = 3, 6.0, (0.33, 3.0), 0.6


def centre_of(seed: np.ndarray, centre: np.ndarray, now: np.ndarray, confidence: np.ndarray, visible: np.ndarray, total: int, radius: float) -> tuple[float, float, bool, float]:
    """(x, y, visible, confidence) of a group's centre from its members on the picture.

    Each pair of members proposes a similarity; the one that most members agree with is fitted again to those.
    Without one, the centre moves by the median displacement, at less confidence.
    """
    if len(seed) >= LEAST_FIT and radius >= LEAST_RADIUS:
        a, b = (p[:, 0] + 1j * p[:, 1] for p in (seed, now))  # a similarity is z -> m z + t
        i, j = np.triu_indices(len(a), 1)
        apart = np.abs(a[i] - a[j]) > 1e-9
        i, j = i[apart], j[apart]
        if len(i):
            m = (b[i] - b[j]) / (a[i] - a[j])
            band = max(3.0, 0.1 * radius)
            near = np.abs(m[:, None] * a + (b[i] - m * a[i])[:, None] - b) <= band
            inside = near[near.sum(1).argmax()]
            da, db = a[inside] - a[inside].mean(), b[inside] - b[inside].mean()
            if inside.sum() >= LEAST_FIT and (spread := (np.abs(da) ** 2).sum()) > 0:
                fit = (np.conj(da) * db).sum() / spread
                if SCALES[0] < abs(fit) < SCALES[1]:
                    z = fit * (complex(*centre) - a[inside].mean()) + b[inside].mean()
                    return z.real, z.imag, bool(visible[inside].mean() > 0.5), min(float(inside.sum() / total * np.median(confidence[inside])), 1.0)
    move = np.median(now - seed, axis=0)
    return *(centre + move), bool(visible.mean() > 0.5), min(float(LOOSE * len(seed) / total * np.median(confidence)), 1.0)


def group_centres(members: DataFrame, keys: tuple[str, ...], width: float, height: float) -> DataFrame:
    """(keys, x, y, visible, confidence) of (keys, seed_x, seed_y, centre_x, centre_y, radius, x, y, confidence, visible): one row a member of a frame's group.

    Members off the picture don't count; without any left there is no centre, at confidence 0. A group holds the
    members of one frame.
    """
    fields = ("seed_x", "seed_y", "x", "y", "confidence")
    inside = (F.col("x") >= -0.5) & (F.col("x") < width - 0.5) & (F.col("y") >= -0.5) & (F.col("y") < height - 0.5)
    one = F.struct(*(F.col(c).cast("double").alias(c) for c in fields), F.col("visible").cast("double").alias("visible"))
    d = members.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("centre_x").alias("__cx"), F.first("centre_y").alias("__cy"), F.first("radius").alias("__r"), F.sort_array(F.collect_list(F.when(inside, one))).alias("__m"))
    d = d.select(*keys, "__n", "__cx", "__cy", "__r", F.flatten(F.transform("__m", lambda s: F.array(*(s[c] for c in (*fields, "visible"))))).alias("__m"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in zip(f["__n"], f["__cx"], f["__cy"], f["__r"], f["__m"], strict=True):
                m = np.asarray(r[4], float).reshape(-1, 6)
                out.append(centre_of(m[:, :2], np.array(r[1:3], float), m[:, 2:4], m[:, 4], m[:, 5], int(r[0]), float(r[3])) if len(m) else (None, None, False, 0.0))
            yield f[list(keys)].reset_index(drop=True).join(pd.DataFrame(out, columns=["__x", "__y", "__v", "__c"])).rename(columns={"__x": "x", "__y": "y", "__v": "visible", "__c": "confidence"})

    kinds = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys)
    return d.mapInPandas(run, f"{kinds}, x double, y double, visible boolean, confidence double")
