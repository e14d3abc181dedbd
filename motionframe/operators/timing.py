"""Whole-frame timing of camera pairs, without calibration, from two landmarks that all cameras follow.

If two cameras' clocks agree, the views of both landmarks over all instants fit one epipolar relation. For each
pair the second camera's clock is moved frame by frame; the share of views that fit peaks where it is right.
Every shift is tried on every instant that a pair shares. A block of instants is a stored row with the raw frames
that any shift may need, so frames travel once (twice near a block's border), and each step is a scan of the
blocks for all pairs and shifts: instants are counted, samples of eight are drawn over all of them and propose
relations, all instants vote on every proposal, and the best one is fitted again to all that agree with it, until
no more do. Shuffled are sums and the drawn points, brought to the driver a row of sums for each pair and shift,
and the proposals, 1.8 MB for a pair at 61 shifts; pairs are taken some at a time. The pairs' peaks, a table of at
most a row for each two cameras, are then joined into one shift for each camera by weighted least squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.operators.alignment import WHOLE
from motionframe.sources.scratch import written

#: Frames tried each way, instants needed of a pair and shift, the band of a fit in pixels of a 1920 pixel picture.
MOST_SHIFT, LEAST_ROWS, BAND = 30, 30, 1.5
#: A pair's peak counts from this share on and so far above the share as it is; from these shifts on a camera is a whole frame or a fraction off.
GOOD_SHARE, MARGIN, WHOLE_FRAME, FRACTION = 0.6, 0.15, 0.75, 0.25
TRIALS, SAMPLE = 400, 8
#: Points that are drawn over all instants, on average, for the ``TRIALS * SAMPLE`` of the proposals; every point votes.
DRAWN = 4000
#: From a relation towards its refit, as multiples of the way: the refit itself, and further, which saves rounds.
STEPS = (1, 2, 4, 8, 16)
#: Instants of a row of ``blocks``, rows that are evaluated and tests that are made at a time, pairs of cameras whose proposals are held at a time.
BLOCK, AT_ONCE, TESTED, PAIRS_AT_ONCE = 256, 16, 25_600, 8


def _normalising(p: np.ndarray) -> np.ndarray:
    centre = p.mean(0)
    scale = np.sqrt(2) / max(np.linalg.norm(p - centre, axis=1).mean(), 1e-12)
    return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])


def _rank_two(f: np.ndarray) -> np.ndarray:
    u, s, w = np.linalg.svd(f)
    s[:, 2] = 0
    return u @ (s[:, :, None] * w)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., 9): what an epipolar matrix, row by row, is multiplied with to tell how far homogeneous point pairs are off."""
    return (b[..., :, None] * a[..., None, :]).reshape(*a.shape[:-1], 9)


_I, _J = np.triu_indices(3)
_ROWS, _COLS = np.triu_indices(9)


@dataclass(frozen=True)
class Relations:
    """Epipolar matrices ``f`` (k, 3, 3) between two pictures, each normalised by its matrix."""

    f: np.ndarray
    ma: np.ndarray
    mb: np.ndarray

    @classmethod
    def proposed(cls, a: np.ndarray, b: np.ndarray, seed: int) -> Relations:
        """One relation for each of ``TRIALS`` samples of the point pairs."""
        ma, mb = _normalising(a), _normalising(b)
        picks = np.argsort(np.random.default_rng(seed).random((TRIALS, len(a))), 1)[:, :SAMPLE]
        _, _, v = np.linalg.svd(_products(_homogeneous(a, ma)[picks], _homogeneous(b, mb)[picks]))
        return cls(_rank_two(v[:, -1].reshape(-1, 3, 3)), ma, mb)

    def refitted(self, normal: np.ndarray) -> Relations:
        """The one relation moved by ``STEPS`` towards the least-squares relation, from the upper triangle of summed squares of products."""
        m = np.zeros((9, 9))
        m[_ROWS, _COLS] = m[_COLS, _ROWS] = normal
        old, new = self.f[0] / np.linalg.norm(self.f[0]), np.linalg.eigh(m)[1][:, 0].reshape(3, 3)
        new = new if (old * new).sum() >= 0 else -new
        return Relations(_rank_two(old + np.array(STEPS)[:, None, None] * (new - old)), self.ma, self.mb)

    def taken(self, k: int) -> Relations:
        return Relations(self.f[k : k + 1], self.ma, self.mb)

    def tests(self, band: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors of the products and of either picture's squares: a pair fits if its product's square is below both others."""
        square = lambda m, scale: (m[:, _I, _J] * np.where(_I == _J, 1, 2) * (band * scale) ** 2).T
        rows, cols = self.f[:, :2], self.f[:, :, :2]
        return self.f.reshape(-1, 9).T, square(np.swapaxes(rows, 1, 2) @ rows, self.mb[0, 0]), square(cols @ np.swapaxes(cols, 1, 2), self.ma[0, 0])


def _homogeneous(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.column_stack([p, np.ones(len(p))]) @ m.T


def _inside(r: Relations, tests: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some point pairs at a time: their products, and (n, k) whether both views lie within the band of the lines that the other camera's views give."""
    a, b = _homogeneous(a, r.ma), _homogeneous(b, r.mb)
    many = max(1, TESTED // len(r.f))
    for lo in range(0, len(a), many):
        p, q = a[lo : lo + many], b[lo : lo + many]
        x = _products(p, q)
        off, most, also = x @ tests[0], (p[:, _I] * p[:, _J]) @ tests[1], (q[:, _I] * q[:, _J]) @ tests[2]
        yield x, np.square(off, out=off) < np.minimum(most, also, out=most)


def _votes(r: Relations, tests: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many point pairs fit each relation."""
    return sum((np.count_nonzero(fits, 0) for _, fits in _inside(r, tests, a, b)), np.zeros(len(r.f)))


def _normal(r: Relations, tests: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each relation, how many point pairs fit it, and the summed squares of their products, upper triangle."""
    out = np.zeros((len(r.f), 1 + len(_ROWS)))
    for x, fits in _inside(r, tests, a, b):
        for k in range(len(r.f)):
            own = x[fits[:, k]]
            out[k, 0] += len(own)
            out[k, 1:] += (own.T @ own)[_ROWS, _COLS]
    return out


def inlier_share(a: np.ndarray, b: np.ndarray, band: float, seed: int = 0) -> float:
    """Share of point pairs within ``band`` of the epipolar relation that most of them fit; ``scored`` does the same in scans.

    Samples of eight pairs propose relations; the best one is fitted again to what agrees with it, or moved
    further that way, until that stops growing. The seed makes the answer a function of its input.
    """
    r = Relations.proposed(a, b, seed)
    votes = _votes(r, r.tests(band), a, b)
    r, best = r.taken(int(votes.argmax())), votes.max()
    own = _normal(r, r.tests(band), a, b)[0]
    while best >= SAMPLE:
        r = r.refitted(own[1:])
        normal = _normal(r, r.tests(band), a, b)
        k = int(normal[:, 0].argmax())
        if normal[k, 0] <= best:
            break
        r, own, best = r.taken(k), normal[k], normal[k, 0]
    return float(best / len(a))


def _frames_with_both(cells: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """(camera, frame, v): both landmarks' places (x1, y1, x2, y2) on each frame that has them."""
    at = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    own = cells.where(F.col("name").isin(*ends)).groupBy("camera", "frame").agg(*(at(n, c).alias(f"{c}{i}") for i, n in enumerate(ends) for c in "xy"))
    return own.where(" AND ".join(f"{c}{i} IS NOT NULL" for i in (0, 1) for c in "xy")).select("camera", "frame", F.array("x0", "y0", "x1", "y1").alias("v"))


def shared_views(cells: DataFrame, cameras: DataFrame, ends: tuple[str, str], shifts: DataFrame, extent: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, shift, frame, p, q): both landmarks' views (x1, y1, x2, y2) in both cameras at each instant ``frame`` that has all.

    ``shifts`` (a, b, shift) is small: pairs of cameras by shifts.
    """
    asked = shifts.select(F.col("b").alias("camera"), "shift").union(shifts.select(F.col("a").alias("camera"), F.lit(0).alias("shift"))).distinct()
    clocks = cameras.join(asked, "camera").withColumn("offset", F.col("offset") + F.col("shift"))
    # Both landmarks on a frame and on the next one are put side by side before clocks are tried, so that a sample at any clock comes from one row.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = _frames_with_both(cells, ends)
    both = own.select("camera", F.explode(F.array(F.struct("frame", F.lit(0).alias("k"), "v"), F.struct((F.col("frame") - 1).alias("frame"), F.lit(1).alias("k"), "v"))).alias("r")).select("camera", "r.*")
    both = both.repartition(parts, "camera", "frame").groupBy("camera", "frame").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("here"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("ahead"))
    d = both.where("here IS NOT NULL").withColumnRenamed("frame", "own").join(F.broadcast(clocks), "camera")
    lo = F.ceil((F.col("own") - F.col("offset")) / F.col("rate") - 1e-6).cast("long")
    hi = F.floor((F.col("own") + 1 - F.col("offset")) / F.col("rate") + 1e-6).cast("long")
    d = d.withColumn("frame", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    f = F.col("rate") * F.col("frame") + F.col("offset")
    near = F.floor(f + 0.5)
    whole = F.abs(f - near) < WHOLE
    d = d.withColumns({"whole": whole, "part": f - F.floor(f)}).where(F.when(whole, near).otherwise(F.floor(f)) == F.col("own")).where("whole OR ahead IS NOT NULL")
    mixed = F.array(*(F.get("here", F.lit(i)) * (1 - F.col("part")) + F.get("ahead", F.lit(i)) * F.col("part") for i in range(4)))
    views = d.where(F.col("frame").between(*extent)) if extent else d
    views = views.select("camera", "shift", "frame", F.when(F.col("whole"), F.col("here")).otherwise(mixed).alias("v"))
    first = views.where("shift = 0").select(F.col("camera").alias("a"), "frame", F.col("v").alias("p"))
    second = views.select(F.col("camera").alias("b"), "shift", "frame", F.col("v").alias("q")).join(F.broadcast(shifts), ["b", "shift"])
    return second.join(first, ["a", "frame"]).select("a", "b", "shift", "frame", "p", "q")


Clocks = Mapping[str, tuple[int, float, float]]
Asked = tuple[str, str, int]


def blocks(cells: DataFrame, clocks: Clocks, ends: tuple[str, str], reach: int) -> DataFrame:
    """(block, w): for each ``BLOCK`` instants in a row, the frames (c, frame, v) that any of them may need at up to ``reach`` frames more or less."""
    side = cells.sparkSession.createDataFrame([(name, *clock) for name, clock in clocks.items()], "camera string, c int, offset double, rate double")
    d = _frames_with_both(cells, ends).join(F.broadcast(side), "camera")
    lo = F.ceil((F.col("frame") - 1 - reach - F.col("offset")) / F.col("rate") - 1e-6).cast("long")
    hi = F.floor((F.col("frame") + 1 + reach - F.col("offset")) / F.col("rate") + 1e-6).cast("long")
    d = d.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    # A partition for each that the session asks for: the scans' work is per row, not per byte.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("c", "frame", "v")).alias("w"))


class _Instants:
    """The instants of some blocks and the frames around them; both landmarks' places at any clock."""

    def __init__(self, block: np.ndarray, c: np.ndarray, frame: np.ndarray, v: np.ndarray, extent: tuple[int, int] | None) -> None:
        t = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        self.t = t[(t >= extent[0]) & (t <= extent[1])] if extent else t
        self.tracks = {}
        for k in np.unique(c).tolist():
            frames, first = np.unique(frame[c == k], return_index=True)  # blocks share frames near their borders
            self.tracks[k] = frames, v[c == k][first]

    def at(self, clock: tuple[int, float, float], shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Which instants have both landmarks, and (n, 4) their places, between two frames by the part of a frame; see ``shared_views``."""
        c, offset, rate = clock
        if c not in self.tracks:
            return np.zeros(len(self.t), bool), np.zeros((len(self.t), 4))
        frames, v = self.tracks[c]
        f = rate * self.t + (offset + shift)
        near, low = np.floor(f + 0.5), np.floor(f)
        whole, part = np.abs(f - near) < WHOLE, (f - low)[:, None]
        own = np.where(whole, near, low).astype(np.int64)
        here = np.minimum(np.searchsorted(frames, own), len(frames) - 1)
        ahead = np.minimum(here + 1, len(frames) - 1)
        got = np.where(whole[:, None], v[here], v[here] * (1 - part) + v[ahead] * part)
        return (frames[here] == own) & (whole | (frames[ahead] == own + 1)) & np.isfinite(got).all(1), got


def _views(tables: Iterator[pa.RecordBatch], clocks: Clocks, asked: Mapping[int, Asked], extent: tuple[int, int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, t, p, q): of some blocks at a time, the instants that the pair has at its shift, and both cameras' places (n, 4)."""
    by: dict[tuple[str, int], list[tuple[int, str]]] = {}
    for k, (a, b, shift) in asked.items():
        by.setdefault((b, shift), []).append((k, a))
    for table in tables:
        for lo in range(0, table.num_rows, AT_ONCE):
            part = table.slice(lo, AT_ONCE)
            w = part.column("w").flatten()
            c, frame = (w.field(x).to_numpy(zero_copy_only=False) for x in ("c", "frame"))
            v = w.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            instants = _Instants(part.column("block").to_numpy(zero_copy_only=False).astype(np.int64), c, frame, v, extent)
            first = {a: instants.at(clocks[a], 0) for a in {a for a, _, _ in asked.values()}}
            for (b, shift), pairs in by.items():
                seen, q = instants.at(clocks[b], shift)
                for k, a in pairs:
                    own = np.flatnonzero(seen & first[a][0])
                    if len(own):
                        yield k, instants.t[own], first[a][1][own], q[own]


def _points(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first landmark's views, then the second one's."""
    return np.vstack([p[:, :2], p[:, 2:]]), np.vstack([q[:, :2], q[:, 2:]])


def _summed(table: DataFrame, clocks: Clocks, asked: Mapping[int, Asked], extent: tuple[int, int] | None, measure: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The sum of ``measure(k, p, q)`` over all instants of each pair and shift that has any."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for k, _, p, q in _views(tables, clocks, asked, extent):
            total[k] = total.get(k, 0) + measure(k, p, q)
        yield pa.RecordBatch.from_pydict({"k": pa.array(total, pa.int32()), "sums": pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))})

    def added(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "sums": [np.sum(np.stack(f["sums"].to_list()), 0)]})

    sums = table.mapInArrow(run, "k int, sums array<double>").groupBy("k").applyInPandas(added, "k int, sums array<double>")
    return {r["k"]: np.array(r["sums"]) for r in sums.collect()}  # a row for each pair and shift


def _seed(a: str, b: str, shift: int) -> int:
    return int.from_bytes(f"{a} {b} {shift}".encode(), "little") % 2**63


def _chance(t: np.ndarray, seed: int) -> np.ndarray:
    """(2, n) numbers from 0 to 1, one for each landmark and instant."""
    z = (2 * t.astype(np.uint64) + np.arange(2, dtype=np.uint64)[:, None] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def _proposals(table: DataFrame, clocks: Clocks, asked: Mapping[int, Asked], counts: Mapping[int, int], extent: tuple[int, int] | None) -> dict[int, Relations]:
    """The relations that samples over all instants of each pair and shift propose."""

    def drawn(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t, p, q in _views(tables, clocks, asked, extent):
            end, i = np.nonzero(_chance(t, _seed(*asked[k])) < DRAWN / (2 * counts[k]))
            if len(i):
                xy = {f"{c}{j}": v.reshape(-1, 2, 2)[i, end, j] for c, v in (("p", p), ("q", q)) for j in (0, 1)}
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(i), k), pa.int32()), "end": pa.array(end, pa.int32()), "t": t[i], **xy})

    def proposed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["end", "t"])
        r = Relations.proposed(f[["p0", "p1"]].to_numpy(), f[["q0", "q1"]].to_numpy(), _seed(*asked[key[0]]))
        return pd.DataFrame({"k": [key[0]], "r": [np.concatenate([r.ma.ravel(), r.mb.ravel(), r.f.ravel()]).tobytes()]})

    points = table.mapInArrow(drawn, "k int, end int, t long, p0 double, p1 double, q0 double, q1 double")
    out = {}
    for row in points.groupBy("k").applyInPandas(proposed, "k int, r binary").collect():  # a row for each pair and shift
        m = np.frombuffer(row["r"]).reshape(-1, 3, 3)
        out[row["k"]] = Relations(m[2:], m[0], m[1])
    return out


def _most_inside(table: DataFrame, clocks: Clocks, asked: Mapping[int, Asked], counts: Mapping[int, int], band: float, extent: tuple[int, int] | None) -> dict[int, int]:
    """How many points of each pair and shift fit the relation that most of them fit, by the steps of ``inlier_share``."""

    def summed(measure: Callable, relations: Mapping[int, Relations]) -> dict[int, np.ndarray]:
        held: dict[int, tuple] = {}

        def own(k: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            if k not in held:
                held[k] = relations[k].tests(band)
            return measure(relations[k], held[k], *_points(p, q))

        got = _summed(table, clocks, {k: asked[k] for k in relations}, extent, own)
        return {k: v.reshape(len(relations[k].f), -1) for k, v in got.items()}

    relations = _proposals(table, clocks, asked, counts, extent)
    votes = summed(_votes, relations)
    best = {k: int(v.max()) for k, v in votes.items()}
    growing = {k: relations[k].taken(int(v.argmax())) for k, v in votes.items() if best[k] >= SAMPLE}
    sums = summed(_normal, growing)
    while growing:
        steps = {k: r.refitted(sums[k][0, 1:]) for k, r in growing.items()}
        normal = summed(_normal, steps)
        further = {k: int(n[:, 0].argmax()) for k, n in normal.items()}
        growing = {k: steps[k].taken(j) for k, j in further.items() if normal[k][j, 0] > best[k]}
        sums = {k: normal[k][further[k]][None] for k in growing}
        best |= {k: int(n[0, 0]) for k, n in sums.items()}
    return best


def scored(cells: DataFrame, cameras: DataFrame, ends: tuple[str, str], shifts: DataFrame, band: float = BAND, extent: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, shift, n, share) of each pair and shift over all instants that they share; ``share`` is NULL where those are fewer than ``LEAST_ROWS``.

    ``shifts`` (a, b, shift) is small: pairs of cameras by shifts.
    """
    clocks = {r["camera"]: (c, float(r["offset"]), float(r["rate"])) for c, r in enumerate(cameras.select("camera", "offset", "rate").collect())}
    every = {k: x for k, x in enumerate(sorted({(r["a"], r["b"], r["shift"]) for r in shifts.collect()})) if x[0] in clocks and x[1] in clocks}
    table = written(blocks(cells, clocks, ends, max((abs(s) for _, _, s in every.values()), default=0)), "timing-blocks")
    counts = {k: int(n[0]) for k, n in _summed(table, clocks, every, extent, lambda k, p, q: np.array([float(len(p))])).items()}
    enough = {k: x for k, x in every.items() if counts.get(k, 0) >= LEAST_ROWS}
    pairs, inside = sorted({x[:2] for x in enough.values()}), {}
    for lo in range(0, len(pairs), PAIRS_AT_ONCE):
        some = set(pairs[lo : lo + PAIRS_AT_ONCE])
        inside |= _most_inside(table, clocks, {k: x for k, x in enough.items() if x[:2] in some}, counts, band, extent)
    rows = [(*every[k], n, inside[k] / (2 * n) if k in inside else None) for k, n in sorted(counts.items())]
    return cells.sparkSession.createDataFrame(rows, "a string, b string, shift int, n long, share double")


def pair_peaks(cells: DataFrame, cameras: DataFrame, ends: tuple[str, str], most: int = MOST_SHIFT, band: float = BAND, extent: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, rows, share0, best, share_best, used) of every two cameras, in the order of ``cameras`` (camera, ord, offset, rate)."""
    left, right = (cameras.select(F.col("camera").alias(c), F.col("ord").alias(f"o{c}")) for c in "ab")
    pairs = left.crossJoin(right).where("oa < ob").select("a", "b")  # a handful of cameras
    scores = scored(cells, cameras, ends, pairs.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))), band, extent)
    best = F.max_by(F.struct("shift", "share"), F.struct("share", -F.abs("shift"), -F.col("shift")))
    zero = lambda c: F.max(F.when(F.col("shift") == 0, F.col(c)))
    got = pairs.join(scores.groupBy("a", "b").agg(F.coalesce(zero("n"), F.lit(0)).alias("rows"), zero("share").alias("share0"), best.alias("best")), ["a", "b"], "left")
    clear = (F.col("rows") >= LEAST_ROWS) & (F.col("best.share") >= GOOD_SHARE) & ((F.col("best.shift") == 0) | (F.col("best.share") - F.col("share0") >= MARGIN))
    return got.select("a", "b", F.coalesce("rows", F.lit(0)).alias("rows"), "share0", F.col("best.shift").alias("best"), F.col("best.share").alias("share_best"), F.coalesce(clear, F.lit(False)).alias("used"))


@dataclass
class Shifts:
    """Shifts of cameras in their own frames: as fitted, whole-frame suggestions, and fractions that mustn't be rounded into one."""

    fitted: dict[str, float] = field(default_factory=dict)
    suggested: dict[str, int] = field(default_factory=dict)
    fractions: dict[str, float] = field(default_factory=dict)
    verdict: str = "unclear"


def fitted_shifts(peaks: Iterable[tuple[str, str, int, int]], rates: Mapping[str, float]) -> Shifts:
    """One shift for each camera from the used pairs (a, b, rows, best); ``rates`` has the cameras in order.

    The unknowns are shifts in reference frames, pairs weigh by their instants. The first camera keeps its
    clock; where it isn't timed, the middle camera does. Only cameras that pairs connect to it are fitted. The
    pairs must agree with the whole-frame shifts to a frame, or nothing is suggested.
    """
    peaks, out = list(peaks), Shifts()
    timed = [c for c in rates if any(c in p[:2] for p in peaks)]
    if not timed:
        return out
    reach = {timed[0]}
    for _ in timed:
        reach |= {c for p in peaks if reach & set(p[:2]) for c in p[:2]}
    peaks, cameras = [p for p in peaks if p[0] in reach], [c for c in timed if c in reach]
    column = {c: k for k, c in enumerate(cameras)}
    m, y = np.zeros((len(peaks), len(cameras))), np.zeros(len(peaks))
    for k, (a, b, rows, best) in enumerate(peaks):
        w = np.sqrt(max(rows, 1))
        m[k, column[b]], m[k, column[a]], y[k] = w, -w, w * best / rates[b]
    u = np.concatenate([[0.0], np.linalg.lstsq(m[:, 1:], y, rcond=None)[0]])
    fitted = {c: float(u[k] * rates[c]) for c, k in column.items()}
    if cameras[0] != next(iter(rates)) and len({round(r, 9) for r in rates.values()}) == 1:
        v = sorted(fitted.values())
        middle = v[len(v) // 2] if len(v) % 2 else min(v[len(v) // 2 - 1 : len(v) // 2 + 1], key=abs)
        fitted = {c: x - middle for c, x in fitted.items()}
    whole = {c: int(np.floor(x + 0.5)) for c, x in fitted.items()}
    out.fitted = fitted
    if any(abs(best - rates[b] * (whole[b] / rates[b] - whole[a] / rates[a])) > 1 + 1e-9 for a, b, _, best in peaks):
        return out
    out.suggested = {c: whole[c] for c, x in fitted.items() if whole[c] and abs(x) >= WHOLE_FRAME}
    out.fractions = {c: x for c, x in fitted.items() if FRACTION <= abs(x) < WHOLE_FRAME}
    out.verdict = "suggest" if out.suggested else "fraction" if out.fractions else "fine"
    return out


def timing_check(cells: DataFrame, cameras: DataFrame, ends: tuple[str, str], most: int = MOST_SHIFT, band: float = BAND, extent: tuple[int, int] | None = None) -> DataFrame:
    """(camera, fitted, suggested, verdict, why) of every camera; ``why`` says what keeps a camera from being timed: few instants, no peak, or no link to the first."""
    spark = cells.sparkSession
    order = cameras.orderBy("ord").select("camera", "rate").collect()
    peaks = pair_peaks(cells, cameras, ends, most, band, extent).collect()  # a row for every two cameras
    fit = fitted_shifts([(p["a"], p["b"], p["rows"], p["best"]) for p in peaks if p["used"]], {r["camera"]: float(r["rate"]) for r in order})
    rows = []
    for c in (r["camera"] for r in order):
        own = [p for p in peaks if c in (p["a"], p["b"])]
        few = max((p["rows"] for p in own), default=0) < LEAST_ROWS
        why = None if c in fit.fitted else "few instants" if few else "not linked" if any(p["used"] for p in own) else "no peak"
        suggested = None if c not in fit.fitted or fit.verdict == "unclear" else fit.suggested.get(c, 0)
        rows.append((c, fit.fitted.get(c), suggested, fit.verdict, why))
    return spark.createDataFrame(rows, "camera string, fitted double, suggested int, verdict string, why string")
