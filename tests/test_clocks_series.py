"""Clock search, timing of pairs and state machines: planted answers, brute force, streams against batch."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import clock_search, timing
from motionframe.plans.adapter import DLT
from motionframe.streaming import machines

# ---- clocks ------------------------------------------------------------------------------------------------

TRUE, GIVEN = (0.0, 2.4, -1.3), (0.0, 2.0, -1.0)


def pixel(c, p):
    k = np.array(DLT[c])
    den = k[8:11] @ p + 1
    return (k[0:3] @ p + k[3]) / den, (k[4:7] @ p + k[7]) / den


def helix(frames=70, swapped=(), still=False):
    rows = []
    for c, off in enumerate(TRUE):
        for f in range(frames):
            t = f - off
            for n, phase in (("a", 0.0), ("b", 2.1)):
                p = np.array([0.2 * math.cos(t / 9 + phase), 0.2 * math.sin(t / 9 + phase), 0.004 * t - 0.1])
                if still:
                    p = np.array([0.1, phase / 10, 0.0])
                name = n if (c, f) not in swapped else "ab".replace(n, "")
                rows.append((f"c{c}", name, f, *map(float, pixel(c, p))))
    return rows


def rig(spark, given=GIVEN):
    cameras = spark.createDataFrame([(f"c{c}", c, o, 1.0) for c, o in enumerate(given)], "camera string, ord int, offset double, rate double")
    return clock_search.rig(cameras, {f"c{c}": DLT[c] for c in range(3)})


CELL = "camera string, name string, frame long, x double, y double"


def test_clock_search_with_swapped_ends(spark):
    d = spark.createDataFrame(helix(swapped={(1, f) for f in (12, 30, 31, 50)}), CELL)
    got = clock_search.estimated_offsets(d, rig(spark), step=0.1, refine=0.02, passes=1, robust=True).orderBy("camera").collect()
    assert [r.offset for r in got] == pytest.approx(TRUE, abs=0.02)
    assert got[0].view == "reference" and got[1].view == got[2].view == "sharp" and got[0].verdict == "reliable" and got[0].n_set_aside >= 8
    assert got[0].after < got[0].before / 5


def test_clock_search_without_information(spark):
    still = spark.createDataFrame(helix(still=True), CELL)
    got = clock_search.estimated_offsets(still, rig(spark), step=0.5, refine=0.25, passes=1).collect()
    assert {r.verdict for r in got} == {"flat"} and [r.offset for r in sorted(got, key=lambda r: r.camera)] == list(GIVEN)
    alone = spark.createDataFrame([r for r in helix() if r[0] != "c2"], CELL)
    got = {r.camera: r for r in clock_search.estimated_offsets(alone, rig(spark), step=0.2, refine=0.05, passes=1).collect()}
    assert got["c2"].view == "none" and got["c2"].offset == GIVEN[2] and got["c1"].offset == pytest.approx(TRUE[1], abs=0.03)
    none = clock_search.estimated_offsets(still.where("false"), rig(spark), step=0.5, refine=0.25, passes=1).collect()
    assert {r.verdict for r in none} == {"flat"} and none[0].before is None


def test_costs_are_undefined_where_a_view_is_lost(spark):
    r = rig(spark)
    table = clock_search.written(clock_search.windows(spark.createDataFrame(helix(), CELL), r), "w")
    near, far = clock_search.costs(table, r, [list(GIVEN), [0.0, GIVEN[1] + 40, GIVEN[2]]])
    assert math.isfinite(near) and far == math.inf
    # By hand: sample and triangulate every stable cell in plain loops.
    tracks = {(c, n, f): (x, y) for c, n, f, x, y in helix()}

    def sample(c, n, at):
        lo = math.floor(at + 1e-9)
        if abs(at - lo) < 1e-9:
            return tracks.get((f"c{c}", n, lo))
        a, b = tracks.get((f"c{c}", n, lo)), tracks.get((f"c{c}", n, lo + 1))
        return None if a is None or b is None else tuple(p + (q - p) * (at - lo) for p, q in zip(a, b))

    total = []
    for n, t in itertools.product("ab", range(-10, 90)):
        views = []
        for c, o in enumerate(GIVEN):
            if all(sample(c, n, t + o + d * (c > 0)) for d in (-1, 0, 1)):
                views.append((c, sample(c, n, t + o)))
        if len(views) < 2:
            continue
        m, y = [], []
        for c, (u, v) in views:
            k = np.array(DLT[c])
            m += [u * k[8:11] - k[0:3], v * k[8:11] - k[4:7]]
            y += [k[3] - u, k[7] - v]
        p = np.linalg.lstsq(np.array(m), np.array(y), rcond=None)[0]
        total.append(math.sqrt(sum((a - u) ** 2 + (b - v) ** 2 for c, (u, v) in views for a, b in [pixel(c, p)]) / max(2 * len(views) - 3, 1)))
    assert near == pytest.approx(sum(total) / len(total), rel=1e-9)


# ---- timing ------------------------------------------------------------------------------------------------


def test_inlier_share_counts_what_fits():
    g = np.random.default_rng(3)
    p = g.normal(size=(120, 3)) * 0.2
    a, b = (np.array([pixel(c, x) for x in p]) for c in (0, 1))
    assert timing.inlier_share(a, b, 1.5) == 1.0
    wrong = g.permutation(120)[:30]
    b[wrong] += g.normal(size=(30, 2)) * 200
    share = timing.inlier_share(a, b, 1.5)
    assert 90 / 120 <= share <= 94 / 120 and share == timing.inlier_share(a, b, 1.5)


def test_shifts_of_pairs():
    rates = {"a": 1.0, "b": 2.0, "c": 1.0, "d": 1.0}
    fit = timing.fitted_shifts([("a", "b", 100, 4), ("b", "c", 50, -5), ("a", "c", 80, -3)], rates)
    assert fit.verdict == "suggest" and fit.suggested == {"b": 4, "c": -3} and "d" not in fit.fitted
    assert timing.fitted_shifts([("a", "b", 10, 0), ("a", "c", 10, 0), ("b", "c", 10, 9)], rates).verdict == "unclear"
    half = timing.fitted_shifts([("a", "c", 10, 0), ("a", "d", 10, 0), ("c", "d", 10, 1)], rates)
    assert half.verdict == "fraction" and set(half.fractions) == {"c", "d"} and not half.suggested
    assert timing.fitted_shifts([], rates).fitted == {} and timing.fitted_shifts([("b", "c", 5, 0)], dict.fromkeys("abc", 1.0)).verdict == "fine"
    three = timing.fitted_shifts([("b", "c", 9, 2), ("b", "d", 9, 0), ("c", "d", 9, -2)], dict.fromkeys("abcd", 1.0))
    assert three.suggested == {"c": 2}  # the first camera isn't timed: the middle one keeps its clock


def test_timing_check(spark):
    # A helix won't do: shifted in time, it is the same curve turned, which one relation fits at every shift.
    path = lambda t, k: np.array([0.2 * math.sin(t / 4 + k), 0.2 * math.sin(t / 3 - 2 * k), 0.15 * math.cos(t / 5 + 3 * k)])
    d = spark.createDataFrame([(f"c{c}", n, f, *map(float, pixel(c, path(f - off, k)))) for c, off in enumerate(TRUE) for f in range(200) for k, n in enumerate("ab")], CELL)
    cameras = spark.createDataFrame([("c0", 0, 0.0, 1.0), ("c1", 1, 0.4, 1.0), ("c2", 2, -1.3, 1.0), ("c3", 3, 0.0, 1.0)], "camera string, ord int, offset double, rate double")
    got = {r.camera: r for r in timing.timing_check(d, cameras, ("a", "b"), most=6).collect()}
    assert (got["c1"].suggested, got["c2"].suggested, got["c3"].why) == (2, 0, "few instants") and got["c0"].verdict == "suggest"


def seen_by_two(points, rate=1, spoiled=(), seed=1):
    """Cells of two cameras that see ``points`` (frames, 2, 3), the first one every ``rate``-th; ``spoiled`` frames of the second are far off."""
    g, rows = np.random.default_rng(seed), []
    for f, ends in enumerate(points):
        for n, p in zip("ab", ends, strict=True):
            if f % rate == 0:
                rows.append(("c0", n, f // rate, *map(float, pixel(0, p))))
            rows.append(("c1", n, f, *map(float, np.array(pixel(1, p)) + (g.normal(size=2) * 300 if f in spoiled else 0))))
    return rows


def test_every_shared_instant_counts(spark):
    """The spoiled views are those that even thinning to 300 instants would leave."""
    points = np.random.default_rng(5).normal(size=(900, 2, 3)) * 0.2
    d = seen_by_two(points, spoiled={math.ceil(k * 899 / 299) for k in range(300)})
    cameras = spark.createDataFrame([("c0", 0, 0.0, 1.0), ("c1", 1, 0.0, 1.0)], "camera string, ord int, offset double, rate double")
    shifts = spark.createDataFrame([("c0", "c1", 0)], "a string, b string, shift int")
    (got,) = timing.scored(spark.createDataFrame(d, CELL), cameras, ("a", "b"), shifts).collect()
    assert got.n == 900 and 600 / 900 <= got.share <= 620 / 900
    at = {(c, n, f): (x, y) for c, n, f, x, y in d}
    a, b = (np.array([at[c, n, f] for n in "ab" for f in range(900)]) for c in ("c0", "c1"))
    assert got.share == pytest.approx(timing.inlier_share(a, b, timing.BAND, timing._seed("c0", "c1", 0)), abs=0.002)


def test_every_shift_is_scored(spark):
    """A peak of a single frame at an odd shift, far from any other."""
    points = np.random.default_rng(6).normal(size=(150, 2, 3)) * 0.2
    d = spark.createDataFrame(seen_by_two(points), CELL)
    cameras = spark.createDataFrame([("c0", 0, 0.0, 1.0), ("c1", 1, -17.0, 1.0)], "camera string, ord int, offset double, rate double")
    (got,) = timing.pair_peaks(d, cameras, ("a", "b")).collect()
    assert (got.best, got.share_best, got.rows, got.used) == (17, 1.0, 133, True)
    pairs = spark.createDataFrame([("c0", "c1", k) for k in range(-30, 31)], "a string, b string, shift int")
    assert timing.scored(d, cameras, ("a", "b"), pairs).where("share is not null").count() == 61


def test_scans_of_blocks_see_what_shared_views_holds(spark):
    """More points than are drawn for proposals, cameras of two rates, frames without one landmark, and an extent."""
    points = np.random.default_rng(7).normal(size=(5400, 2, 3)) * 0.2
    spoiled = set(np.random.default_rng(8).permutation(5400)[:1620].tolist())
    cells = spark.createDataFrame([r for r in seen_by_two(points, 2, spoiled) if (r[2] + len(r[0] + r[1])) % 31 or r[1] == "a"], CELL)
    cameras = spark.createDataFrame([("c0", 0, 0.0, 1.0), ("c1", 1, 0.0, 2.0)], "camera string, ord int, offset double, rate double")
    for offset, extent in ((0.0, None), (0.0, (40, 700)), (-0.25, None)):
        own = cameras.withColumn("offset", F.when(F.col("ord") == 1, offset).otherwise(0.0))
        shifts = spark.createDataFrame([("c0", "c1", k) for k in (-30, -1, 0, 1, 7)], "a string, b string, shift int")
        want = {r["shift"]: r["count"] for r in timing.shared_views(cells, own, ("a", "b"), shifts, extent).groupBy("shift").count().collect()}
        got = {r.shift: r for r in timing.scored(cells, own, ("a", "b"), shifts, extent=extent).collect()}
        assert {k: r.n for k, r in got.items()} == want and len(want) == 5
        if offset == 0:
            assert 0.66 <= got[0].share <= 0.74 and all(r.share < 0.1 for k, r in got.items() if k)
    assert want[0] * 2 > timing.DRAWN
    assert timing.scored(cells.where("false"), cameras, ("a", "b"), shifts).count() == 0


# ---- machines ----------------------------------------------------------------------------------------------


def looked(boxes_by_frame, n=2):
    m = machines.PeopleColumns(n)
    out = {}
    for frame, boxes in boxes_by_frame:
        for _, person, column in m.step(frame, [{"person": i, "x0": x, "y0": y, "x1": x + 10, "y1": y + w} for i, (x, y, w) in enumerate(boxes)]):
            out[frame, person] = column
    return out


def test_people_keep_their_columns():
    got = looked([(0, [(0, 0, 10), (100, 0, 30)]), (1, [(101, 0, 30), (2, 0, 10)]), (2, [(3, 0, 10)]), (3, [(300, 300, 10), (3, 0, 10)]), (5, [(108, 20, 30), (60, 200, 90)])])
    assert got[0, 1] == 0 and got[0, 0] == 1  # the bigger one takes the first column
    assert (got[1, 0], got[1, 1], got[2, 0]) == (0, 1, 1)
    assert got[3, 0] == -1 and got[3, 1] == 1  # a stranger isn't written into a reserved column
    assert got[5, 0] == 0 and got[5, 1] == -1  # back within reach
    late = looked([(0, [(0, 0, 10)]), *((f, []) for f in range(1, 32)), (32, [(500, 500, 10)])], n=1)
    assert late[32, 0] == 0  # no longer reserved
    assert looked([(0, [(0, 0, 10)]), *((f, []) for f in range(1, 30)), (30, [(500, 500, 10)])], n=1)[30, 0] == -1


def animal(frame, x, area=50, score=1.0, prompted=False):
    return frame, [{"area": area, "score": score, "cx": float(x), "cy": 0.0, "x0": 0, "y0": 0, "x1": 5, "y1": 7, "prompted": prompted}]


def test_animals_switch_and_get_lost():
    def ends(rows):
        m = machines.AnimalPresence()
        return [x for f, r in rows for x in m.step(f, r)]

    assert ends([animal(f, 3 * f) for f in range(50)]) == []
    assert ends([animal(0, 0), animal(1, 100)]) == [(1, 1, "switched")]
    assert ends([animal(f, 3 * f) for f in range(8)] + [animal(f, 0, area=0) for f in range(8, 12)] + [animal(12, 36)]) == []
    assert ends([animal(f, 3 * f) for f in range(8)] + [animal(f, 0, area=0) for f in range(8, 12)] + [animal(12, 90), animal(13, 93)]) == [(8, 12, "switched")]
    lost = [animal(f, 0) for f in range(3)] + [animal(f, 0, score=0.0) for f in range(3, 40)] + [animal(40, 70, prompted=True), animal(41, 500)]
    assert ends(lost) == [(3, 18, "lost"), (41, 41, "switched")]
    assert ends([animal(f, 0) for f in range(3)] + [animal(f, 0, score=0.0) for f in range(3, 18)] + [animal(18, 0)]) == []


def test_spots_follow_and_stop():
    def run(frames, width=200.0):
        m = machines.MovingSpot(width, 100.0)
        return [m.step(f, [{"x": x, "y": y, "strength": s, "noise": 1.0, "seed": seed} for x, y, s, seed in rows]) for f, rows in enumerate(frames)]

    path = [[(20.0, 50.0, 10.0, True)]] + [[(20.0 + 8 * f, 50.0, 10.0, False), (150.0, 90.0, 40.0, False)] for f in range(1, 10)]
    got = run(path)
    assert [x[0][1] for x in got] == [20.0 + 8 * f for f in range(10)] and all(x[0][4] is None for x in got)
    alike = run([*path[:5], [(60.0, 50.0, 10.0, False), (64.0, 50.0, 9.0, False)], path[6]])
    assert alike[5] == [(5, None, None, None, "ambiguous")] and alike[6] == []
    assert run([*path[:5], []])[5][0][4] == "missing" and run([*path[:5], [(60.0, 50.0, 30.0, False)]])[5][0][4] == "ambiguous"
    assert run([*path[:5], [(60.0, 50.0, 2.9, False)]])[5][0][4] == "missing"  # under three times the noise
    assert run([*path, []], 105.0)[-1][0][4] == "left"
    assert run([[(20.0, 50.0, 10.0, True)], [(24.0, 50.0, 9.0, False), (10.0, 50.0, 11.0, False)]])[1][0][4] == "ambiguous"


T0 = dt.datetime(2024, 1, 1)
PEOPLE = "clip string, frame long, ts timestamp, person long, x0 double, y0 double, x1 double, y1 double"


def test_stream_equals_batch_out_of_order_and_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    at = lambda f: T0 + dt.timedelta(seconds=f)
    rows = []
    for clip, f in itertools.product("ab", range(40)):
        for p in range(rng.randint(0, 3)):
            x, y = rng.random() * 30 + p * 40, rng.random() * 20
            rows.append((clip, f, at(f), p, x, y, x + 20, y + 20 + p))
    d = spark.createDataFrame(rows, PEOPLE)
    want = sorted(map(tuple, machines.in_batch(d, ("clip",), machines.PeopleColumns).collect()))
    # Rows come in files that overlap by up to eight seconds, fewer than the ten the watermark waits.
    parts = [[], [], []]
    for r in rows:
        parts[min(2, max(0, r[1] + rng.randint(-4, 3)) // 14)].append(r)
    parts[2] += [("end", 10**6, at(10**5), 0, 0.0, 0.0, 1.0, 1.0)]
    parts.append([("a", 3, at(3), 9, 0.0, 0.0, 500.0, 500.0), ("end", 10**6 + 1, at(10**5 + 60), 0, 0.0, 0.0, 1.0, 1.0)])  # far too late: changes nothing

    def run():
        s = machines.in_stream(spark.readStream.schema(PEOPLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ("clip",), machines.PeopleColumns)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None

    for k, part in enumerate(parts):
        spark.createDataFrame(rng.sample(part, len(part)), PEOPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (0, 2, 3):
            run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where(F.col("clip") != "end").collect()))
    assert got == want


def test_clock_windows_hold_each_frame_once_or_twice(spark):
    cells, r = spark.createDataFrame(helix(), CELL), rig(spark)
    held = clock_search.windows(cells, r).agg(F.sum(F.size("w"))).first()[0]
    assert cells.count() <= held <= 2 * cells.count()
    twice = cells.union(cells.limit(1).withColumn("x", F.col("x") + 1))
    with pytest.raises(Exception, match="twice on one frame"):
        clock_search.costs(clock_search.windows(twice, r), r, [list(GIVEN)])


def test_shared_views_sample_each_clock_without_a_shuffle_of_its_own(spark):
    """Frames are grouped twice, for all clocks together; samples are then only joined."""
    cells = spark.createDataFrame([(c, n, f, float(f), float(f * f)) for c in ("c0", "c1") for n in "ab" for f in range(12) if f != 6], CELL)
    cameras = spark.createDataFrame([("c0", 0, 0.0, 1.0), ("c1", 1, 0.25, 1.0)], "camera string, ord int, offset double, rate double")
    shifts = spark.createDataFrame([("c0", "c1", k) for k in (-1, 0, 1)], "a string, b string, shift int")
    d = timing.shared_views(cells, cameras, ("a", "b"), shifts)
    got = {(r.shift, r.frame): (r.p, r.q) for r in d.collect()}
    have = set(range(12)) - {6}
    assert set(got) == {(k, t) for k in (-1, 0, 1) for t in have if t + k in have and t + k + 1 in have}
    for (k, t), (p, q) in got.items():
        y = 0.75 * (t + k) ** 2 + 0.25 * (t + k + 1) ** 2
        assert p == [t, t * t, t, t * t] and q == pytest.approx([t + k + 0.25, y, t + k + 0.25, y])
    optimized = d._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in x and "shift" in x and "frame" in x for x in optimized.split("\n"))
