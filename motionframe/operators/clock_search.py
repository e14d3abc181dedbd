"""Sub-frame clocks from the tracks themselves: the offsets at which the cameras' views triangulate best.

Every landmark and block of reference instants becomes one row that holds, for each camera, the raw frames
around their local frames, wide enough for every offset the search may try. That takes one shuffle, in which a
frame travels once, or twice near a block's border; the table is stored. Each round of the search is then a scan
of it: all candidate offsets of the round are evaluated on some blocks at a time, and only one sum for each
candidate and task is shuffled. The driver holds the offsets of the cameras and the candidates of a round,
nothing that grows with the data.

A round's candidates are a grid for one camera (coarse, then fine), or, at the end, offsets of all cameras at
once around the best ones, at a spacing that halves when none of them is better.

Scored are the views with data over the whole search width, so that no candidate gains by losing cells; a
candidate that loses one is never chosen. All stable instants count, moving or not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.operators.quantiles import medians
from motionframe.sources.scratch import written

#: In a robust search a cell is set aside over so many medians, one camera is blamed where the next rest is so much worse, and fewer own cells make a verdict weak.
OUTLIER_MEDIANS, BLAME_MARGIN, LEAST_OWN_CELLS = 4.0, 1.5, 30
#: Rises of the cost half a frame away from which a camera's minimum is sharp, weak or that of a scene at rest.
SHARP, WEAK, AT_REST = 0.10, 0.03, 0.005
WHOLE = 1e-9
#: Instants of a row of ``windows``, and rows that are evaluated at a time.
BLOCK, AT_ONCE = 64, 128
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Rig:
    """The cameras in order; the first one's clock is the reference and stays."""

    names: tuple[str, ...]
    rates: tuple[float, ...]
    offsets: tuple[float, ...]
    coefs: tuple[tuple[float, ...], ...]
    widths: tuple[float, ...]

    @property
    def reach(self) -> tuple[int, ...]:
        """Frames kept on each side of a camera's local frame: twice the search, for a second pass may start at its end."""
        return tuple(math.ceil(2 * w) + 1 for w in self.widths)


def rig(cameras: DataFrame, calibration: Mapping[str, Sequence[float]], search: float = 1.0) -> Rig:
    """From (camera, ord, offset, rate), a handful of rows; a camera's search is at least its rate wide."""
    rows = cameras.orderBy("ord").collect()
    return Rig(tuple(r["camera"] for r in rows), tuple(float(r["rate"]) for r in rows), tuple(float(r["offset"]) for r in rows), tuple(tuple(calibration[r["camera"]]) for r in rows), tuple(max(search, float(r["rate"])) for r in rows))


def _lengths(r: Rig) -> tuple[int, ...]:
    """Frames of each camera that a block holds."""
    return tuple(math.ceil(rate * (BLOCK - 1)) + 2 * n + 3 for rate, n in zip(r.rates, r.reach, strict=True))


def windows(cells: DataFrame, r: Rig) -> DataFrame:
    """(name, block, w): for each landmark and ``BLOCK`` instants in a row, the frames (k, x, y) of all cameras that any of them may need.

    The cameras' stretches of frames lie one behind the other, ``k`` counts through them; frames without data are left out.
    """
    lengths = _lengths(r)
    start = np.cumsum((0, *lengths)).tolist()
    own = cells.select("camera", "name", "frame", "x", "y").where("x is not null and y is not null")
    side = cells.sparkSession.createDataFrame([(c, r.rates[i], r.offsets[i], r.reach[i], start[i], lengths[i]) for i, c in enumerate(r.names)], "camera string, rate double, offset double, reach int, start int, length int")
    d = own.join(F.broadcast(side), "camera")
    # An instant has frames floor(rate * t + offset) - reach and the 2 * reach + 1 after it.
    lo = F.ceil((F.col("frame") - F.col("reach") - 1 - F.col("offset")) / F.col("rate") - 1e-6).cast("long")
    hi = F.floor((F.col("frame") + F.col("reach") + 1 - F.col("offset")) / F.col("rate") + 1e-6).cast("long")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK))))
    at = F.col("frame") - F.floor(F.col("rate") * (F.col("block") * BLOCK) + F.col("offset")) + F.col("reach")
    d = d.withColumn("at", at).where((F.col("at") >= 0) & (F.col("at") < F.col("length")))
    # A partition for each that the session asks for: the rounds scan this table, and their work is per row, not per byte.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "name", "block").groupBy("name", "block").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).cast("int").alias("k"), "x", "y")).alias("w"))


class _Batch:
    """The instants of some blocks as arrays; samples and residuals at any offsets."""

    def __init__(self, r: Rig, t: np.ndarray, place: np.ndarray, base: list[np.ndarray], tracks: list[np.ndarray]) -> None:
        """``place`` is each instant's block, ``base`` each camera's first frame of the block, ``tracks`` the (blocks, frames, 2) of each camera."""
        self.r, self.t, self.place, self.base, self.tracks = r, t, place, base, tracks
        self.local = [rate * t for rate in r.rates]
        self.first = [np.floor(x + off) - n for x, off, n in zip(self.local, r.offsets, r.reach, strict=True)]

    def taken(self, rows: np.ndarray) -> _Batch:
        return _Batch(self.r, self.t[rows], self.place[rows], [b[rows] for b in self.base], self.tracks)

    def sample(self, c: int, offset: float) -> np.ndarray:
        """(rows, 2) at the fractional local frame; NaN where a neighbour is missing or out of reach."""
        at = self.local[c] + offset - self.first[c]
        near = np.floor(at + 0.5)
        at = np.where(np.abs(at - near) < WHOLE, near, at)
        low = np.floor(at)
        part = (at - low)[:, None]
        top = 2 * self.r.reach[c] + 1
        inside = (low >= 0) & (low + (part[:, 0] > 0) <= top)
        track = self.tracks[c]
        flat, row = track.reshape(-1, 2), self.place * track.shape[1]
        i = row + np.clip(self.first[c] - self.base[c] + np.clip(low, 0, top), 0, track.shape[1] - 1).astype(np.int64)
        a, b = flat[i], flat[np.minimum(i + 1, row + track.shape[1] - 1)]
        return np.where(inside[:, None], np.where(part > 0, a * (1 - part) + b * part, a), np.nan)

    def stable(self) -> np.ndarray:
        """(rows, cameras): data at the instant and over the whole width, probed at most a frame apart."""
        out = []
        for c, w in enumerate(self.r.widths):
            m = 1 if w < 2 else math.ceil(w - 1e-9)
            probes = [self.r.offsets[c]] if c == 0 else [self.r.offsets[c] + w * k / m for k in range(-m, m + 1)]
            out.append(np.all([np.isfinite(self.sample(c, o)).all(1) for o in probes], axis=0))
        return np.column_stack(out)

    def terms(self, c: int, u: np.ndarray, v: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
        """What a camera's view adds to the six sums of squares and three right sides of a point's normal equations."""
        k = self.r.coefs[c]
        a, b = ([np.where(keep, w * k[8 + j] - k[row + j], 0.0) for j in range(3)] for w, row in ((u, 0), (v, 4)))
        p, q = (np.where(keep, k[row + 3] - w, 0.0) for w, row in ((u, 0), (v, 4)))
        return [a[i] * a[j] + b[i] * b[j] for i in range(3) for j in range(i, 3)] + [a[i] * p + b[i] * q for i in range(3)]

    def squares(self, c: int, x: Sequence[np.ndarray], u: np.ndarray, v: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Squared distance of a point's picture to a camera's view; nothing where it has none."""
        k = self.r.coefs[c]
        line = lambda o, last: k[o] * x[0] + k[o + 1] * x[1] + k[o + 2] * x[2] + last
        den = line(8, 1.0)
        return np.where(keep, (line(0, k[3]) / den - u) ** 2 + (line(4, k[7]) / den - v) ** 2, 0.0)

    def residuals(self, uv: np.ndarray) -> np.ndarray:
        """Of (rows, cameras, 2) views; NaN where fewer than two cameras see a point."""
        seen = np.isfinite(uv).all(2)
        views = [(uv[:, c, 0], uv[:, c, 1], seen[:, c]) for c in range(uv.shape[1])]
        return self.summed(views, [self.terms(c, *view) for c, view in enumerate(views)])

    def summed(self, views: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], terms: Sequence[Sequence[np.ndarray]]) -> np.ndarray:
        """Residuals of (u, v, seen) of each camera with what each adds to the normal equations."""
        n = np.sum([seen for _, _, seen in views], axis=0)
        with np.errstate(all="ignore"):
            x, fine = _solved([sum(parts[1:], parts[0]) for parts in zip(*terms, strict=True)])
            e = sum(self.squares(c, x, *view) for c, view in enumerate(views))
            return np.where((n >= 2) & fine, np.sqrt(e / np.maximum(2 * n - 3, 1)), np.nan)


def _solved(s: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The solutions of symmetric 3 x 3 systems by elimination, and where they have one; ``s`` has the upper triangle by rows and the right side."""
    m00, m01, m02, m11, m12, m22, b0, b1, b2 = s
    f, g = m01 / m00, m02 / m00
    d11, d12, d22 = m11 - f * m01, m12 - f * m02, m22 - g * m02
    c1, c2 = b1 - f * b0, b2 - g * b0
    h = d12 / d11
    e22 = d22 - h * d12
    z = (c2 - h * c1) / e22
    y = (c1 - d12 * z) / d11
    return [(b0 - m01 * y - m02 * z) / m00, y, z], np.abs(m00 * d11 * e22) > 0


def _batches(tables: Iterator[pa.RecordBatch], r: Rig) -> Iterator[tuple[np.ndarray, _Batch]]:
    """Names and instants of some blocks at a time."""
    lengths = _lengths(r)
    cuts, width = np.cumsum(lengths)[:-1], sum(lengths)
    for table in tables:
        for lo in range(0, table.num_rows, AT_ONCE):
            part = table.slice(lo, AT_ONCE)
            w, block = part.column("w"), part.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
            cells = w.flatten()
            spot = np.repeat(np.arange(len(block)), np.diff(w.offsets.to_numpy())) * width + cells.field("k").to_numpy()
            xy = np.column_stack([cells.field(c).to_numpy(zero_copy_only=False) for c in "xy"])
            dense = np.full((len(block) * width, 2), np.nan)
            dense[spot] = xy
            if not np.array_equal(dense[spot], xy, equal_nan=True):
                raise ValueError("a camera has a landmark twice on one frame, at different places")
            tracks = [np.ascontiguousarray(x) for x in np.split(dense.reshape(len(block), width, 2), cuts, axis=1)]
            place = np.repeat(np.arange(len(block)), BLOCK)
            t = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel().astype(float)
            base = [(np.floor(rate * (block * BLOCK) + off) - n)[place] for rate, off, n in zip(r.rates, r.offsets, r.reach, strict=True)]
            yield part.column("name").to_numpy(zero_copy_only=False)[place], _Batch(r, t, place, base, tracks)


def costs(table: DataFrame, r: Rig, candidates: Sequence[Sequence[float]], own: int | None = None, cap: float = math.inf) -> list[float]:
    """The mean residual of the scored cells at each candidate's offsets; infinite where a scored view is lost or nothing is scored.

    ``own`` restricts the cells to those that a camera shares; ``cap`` bounds what a cell can count. What a camera
    adds at an offset is computed once for all candidates that have it there.
    """
    often = {key for key, n in Counter((c, o) for offsets in candidates for c, o in enumerate(offsets)).items() if n > 1}

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(candidates), 3))
        for _, batch in _batches(tables, r):
            keep = batch.stable()
            rows = keep.sum(1) >= 2
            if own is not None:
                rows &= keep[:, own]
            if not rows.any():
                continue
            part, kept = batch.taken(rows), [np.ascontiguousarray(k) for k in keep[rows].T]
            held: dict[tuple[int, float], tuple] = {}

            def view(c: int, o: float, part=part, kept=kept, held=held) -> tuple:
                if (c, o) in held:
                    return held[c, o]
                u, v = part.sample(c, o).T.copy()
                lost = bool((kept[c] & ~(np.isfinite(u) & np.isfinite(v))).any())
                out = (u, v, kept[c]), part.terms(c, u, v, kept[c]), lost
                if (c, o) in often:
                    held[c, o] = out
                return out

            for k, offsets in enumerate(candidates):
                views, terms, lost = zip(*(view(c, o) for c, o in enumerate(offsets)), strict=True)
                if any(lost):
                    total[k, 2] += 1
                    continue
                res = part.summed(views, terms)
                res = np.minimum(res[np.isfinite(res)], cap)
                total[k, :2] += res.sum(), len(res)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(candidates)), pa.int32()), "total": total[:, 0], "n": total[:, 1], "lost": total[:, 2]})

    sums = table.mapInArrow(run, "k int, total double, n double, lost double").groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("lost").alias("lost"))
    out = [math.inf] * len(candidates)
    for row in sums.collect():  # one row for each candidate of the round
        if row["n"] and not row["lost"]:
            out[row["k"]] = row["total"] / row["n"]
    return out


def residuals_at(table: DataFrame, r: Rig, offsets: Sequence[float], stable_only: bool = False) -> DataFrame:
    """(name, t, residual, blamed): ``blamed`` lists cameras by position, see ``outlying_cells``; NULL where nothing is triangulated."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, batch in _batches(tables, r):
            uv = np.stack([batch.sample(c, o) for c, o in enumerate(offsets)], 1)
            if stable_only:
                uv[~batch.stable()] = np.nan
            full = batch.residuals(uv)
            seen = np.isfinite(uv).all(2)
            rest = np.full(seen.shape, np.inf)
            for c in range(seen.shape[1]):
                part = uv.copy()
                part[:, c] = np.nan
                got = batch.residuals(part)
                rest[:, c] = np.where(seen[:, c] & np.isfinite(got), got, np.inf)
            order = np.sort(rest, 1)
            with np.errstate(invalid="ignore"):
                clear = (seen.sum(1) >= 3) & np.isfinite(order[:, 0]) & (order[:, 1] > BLAME_MARGIN * order[:, 0]) & (order[:, 1] > 0.5 * full)
            got = np.flatnonzero(np.isfinite(full))
            who = [[int(rest[i].argmin())] if clear[i] else np.flatnonzero(seen[i]).tolist() for i in got]
            yield pa.RecordBatch.from_pydict({"name": pa.array(names[got], pa.string()), "t": batch.t[got].astype(np.int64), "residual": full[got], "blamed": pa.array(who, pa.list_(pa.int32()))})

    return table.mapInArrow(run, "name string, t long, residual double, blamed array<int>")


def outlying_cells(table: DataFrame, r: Rig, offsets: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(camera, name, frame) behind the cells that are far off at ``offsets``, and those cells (name, t).

    A camera is blamed alone where the others agree without it and no other camera explains it; otherwise all
    that saw the cell are. Both frames of an interpolated view go.
    """
    at = written(residuals_at(table, r, offsets), "residuals")
    limit = OUTLIER_MEDIANS * (medians(at, F.col("residual")).first()["median"] or math.inf)
    bad = at.where(F.col("residual") > limit)
    side = table.sparkSession.createDataFrame([(i, c, r.rates[i], float(offsets[i])) for i, c in enumerate(r.names)], "c int, camera string, rate double, offset double")
    low = F.floor(F.col("rate") * F.col("t") + F.col("offset"))
    frames = bad.select("name", "t", F.explode("blamed").alias("c")).join(F.broadcast(side), "c")
    return frames.select("camera", "name", F.explode(F.array(low, low + 1)).alias("frame")).distinct(), bad.select("name", "t")


def _steps(width: float, step: float) -> list[float]:
    n = math.floor(2 * width / step + 1e-9)
    return [-width + step * k for k in range(n + 1)]


def search(table: DataFrame, r: Rig, step: float = 0.05, refine: float = 0.005, passes: int = 2, cap: float = math.inf, finest: float = 2e-4) -> tuple[list[float], float, float]:
    """(offsets, cost before, cost after): grids for one camera after the other, then all cameras at once on a shrinking pattern."""
    best = list(r.offsets)
    before = cost = costs(table, r, [best], cap=cap)[0]
    for _ in range(passes):
        for c in range(1, len(r.names)):
            for around in (_steps(r.widths[c], step), _steps(step, refine)):
                tried = [[*best[:c], best[c] + d, *best[c + 1 :]] for d in around]
                found = costs(table, r, tried, cap=cap)
                k = int(np.argmin(found))
                if found[k] < cost - LEAST_GAIN:  # a flat cost moves nothing
                    best, cost = tried[k], found[k]
    free = len(best) - 1
    spacing, centre, proposed = refine, np.array(best), []
    while free and math.isfinite(cost) and spacing >= finest:
        moves = np.vstack([s * np.eye(free)[i] for i in range(free) for s in (-1, 1)] + [si * np.eye(free)[i] + sj * np.eye(free)[j] for i in range(free) for j in range(i) for si in (-1, 1) for sj in (-1, 1)])
        far = 4 * spacing * np.array([s * np.eye(free)[i] for i in range(free) for s in (-1, 1)])
        tried = [[best[0], *(np.array(best[1:]) + m)] for m in (*spacing * moves, *far)] + proposed
        found = costs(table, r, tried, cap=cap)
        # The quadratic through the neighbours proposes one more candidate for the next round.
        newton = _newton(np.array(found), cost, moves, free, spacing)
        proposed = [] if newton is None else [[best[0], *(np.array(best[1:]) + newton)]]
        k = int(np.argmin(found))
        inside = np.abs(np.array(tried[k]) - centre) <= step + np.array(r.widths)
        if found[k] < cost and inside.all():
            best, cost = tried[k], found[k]
        else:
            spacing /= 4
    return [float(o) for o in best], before, cost


def _newton(found: np.ndarray, cost: float, moves: np.ndarray, free: int, spacing: float) -> np.ndarray | None:
    """The minimum of the quadratic through the neighbours, if it has one close by."""
    if not np.isfinite(found[: len(moves)]).all():
        return None
    value = {tuple(m): v for m, v in zip(moves.tolist(), found, strict=False)}
    at = lambda *ij: value[tuple(sum(s * np.eye(free)[i] for i, s in ij).tolist())]
    g = np.array([(at((i, 1)) - at((i, -1))) / 2 for i in range(free)])
    h = np.diag([at((i, 1)) + at((i, -1)) - 2 * cost for i in range(free)])
    for i in range(free):
        for j in range(i):
            h[i, j] = h[j, i] = (at((i, 1), (j, 1)) - at((i, 1), (j, -1)) - at((i, -1), (j, 1)) + at((i, -1), (j, -1))) / 4
    if np.linalg.eigvalsh(h)[0] <= 0:
        return None
    step = -np.linalg.solve(h, g)
    return spacing * step if np.abs(step).max() < 20 else None


def estimated_offsets(cells: DataFrame, r: Rig, step: float = 0.05, refine: float = 0.005, passes: int = 2, robust: bool = False) -> DataFrame:
    """(camera, offset, sharpness, own_cells, view, before, after, n_set_aside, verdict) of every camera.

    ``sharpness`` is how much the cost of a camera's own cells rises half a frame off. ``view`` says what that
    makes of the camera: the reference, sharp, weak, flat, or none without shared cells. ``verdict`` is
    reliable, weak or flat for all. ``robust`` first searches with capped cells, removes what is behind the
    cells that are far off there, and searches again from the given offsets.
    """
    spark = cells.sparkSession
    table = written(windows(cells, r), "clock-windows")
    aside = 0
    if robust:
        middle = medians(residuals_at(table, r, r.offsets, stable_only=True), F.col("residual")).first()["median"]
        near, _, _ = search(table, r, step, refine, passes, cap=OUTLIER_MEDIANS * middle if middle else math.inf)
        frames, bad = outlying_cells(table, r, near)
        aside = bad.count()
        if aside:
            table = written(windows(cells.join(frames, ["camera", "name", "frame"], "left_anti"), r), "clock-windows")
    best, before, after = search(table, r, step, refine, passes)
    counts = _own_cells(table, r)
    rows, views = [(r.names[0], best[0], None, counts[0], "reference")], {}
    for c in range(1, len(best)):
        sharp = None
        if counts[c]:
            base, *sides = costs(table, r, [[*best[:c], best[c] + d, *best[c + 1 :]] for d in (0.0, -0.5, 0.5)], own=c)
            rises = [(s - base) / max(base, 1e-9) for s in sides if math.isfinite(s) and math.isfinite(base)]
            sharp = min(rises, default=None)
        views[c] = "none" if not counts[c] else "flat" if sharp is None or sharp < WEAK else "sharp" if sharp >= SHARP and counts[c] >= LEAST_OWN_CELLS else "weak"
        rows.append((r.names[c], best[c], sharp, counts[c], views[c]))
    told = [c for c, v in views.items() if v != "none"]
    sharps = [rows[c][2] for c in told]
    if not told or counts[-1] < 10 or all(s is None or s < AT_REST for s in sharps):
        verdict = "flat"
    else:
        verdict = "reliable" if all(views[c] == "sharp" for c in told) else "flat" if "flat" in views.values() else "weak"
    fine = lambda x: x if math.isfinite(x) else None
    out = [(*row, fine(before), fine(after), aside, verdict) for row in rows]
    return spark.createDataFrame(out, "camera string, offset double, sharpness double, own_cells long, view string, before double, after double, n_set_aside long, verdict string")


def _own_cells(table: DataFrame, r: Rig) -> list[int]:
    """Scored cells that each camera shares with another, and at the end all scored cells."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, batch in _batches(tables, r):
            keep = batch.stable()
            shared = keep[keep.sum(1) >= 2]
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(r.names) + 1), pa.int32()), "n": np.array([*shared.sum(0), len(shared)], np.int64)})

    found = {row["c"]: row["n"] for row in table.mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    return [int(found.get(c, 0)) for c in range(len(r.names) + 1)]
