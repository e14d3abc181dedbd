"""Project tables: cameras and their clocks, landmarks and segments by camera, notes, plans for runs, exports of all cameras.

Dimensions (cameras, landmarks, notes) are tables like any other; edits return new tables, so the version
before an edit is the table before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import exportable, half_up, in_frame, name_key
from motionframe.operators.quantiles import medians
from motionframe.operators.runs import SERIES, hand_stretches
from motionframe.sources.scratch import written

#: Ratios this close (relative) to a fraction with a denominator up to the second number are that fraction.
RATE_NEAR, RATE_DENOMINATOR = 1e-9, 1000
#: Velocity kept from step to step; older steps than KEPT_STEPS weigh less than a double resolves.
KEEP, KEPT_STEPS = 0.5, 64


# ---- clocks ---------------------------------------------------------------------------------------------------


def rate_of(fps: Column, reference_fps: Column) -> Column:
    """Frames of a camera per reference frame; float noise around a simple fraction is taken off."""
    r = fps / reference_fps
    near = F.filter(F.transform(F.sequence(F.lit(1), F.lit(RATE_DENOMINATOR)), lambda d: F.round(r * d) / d), lambda q: F.abs(q - r) <= RATE_NEAR * r)
    return F.when((fps <= 0) | (reference_fps <= 0), F.lit(1.0)).otherwise(F.coalesce(F.get(near, F.lit(0)), r))


def _usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def with_offset(cameras: DataFrame, camera: Column, offset: Column) -> DataFrame:
    """Sets an offset where ``camera`` holds; the reference (order 0) keeps 0, a number that isn't finite changes nothing."""
    return cameras.withColumn("offset", F.when(camera & (F.col("ord") != 0) & _usable(offset), offset.cast("double")).otherwise(F.col("offset")))


def with_rate(cameras: DataFrame, camera: Column, rate: Column) -> DataFrame:
    """Sets a rate where ``camera`` holds; the reference keeps 1, only finite positive rates count."""
    return cameras.withColumn("rate", F.when(camera & (F.col("ord") != 0) & _usable(rate) & (rate > 0), rate.cast("double")).otherwise(F.col("rate")))


def with_fps(cameras: DataFrame, order: int, fps: float) -> DataFrame:
    """Sets the real frame rate of one camera and rescales rates, so that offsets and ratios set by hand stay.

    A camera's own rate scales by new over old; for the reference every other rate scales the other way.
    """
    known = cameras.where((F.col("ord") == order) & (F.col("fps") > 0) & (F.abs(F.col("fps") - fps) > 1e-9)).select((F.lit(fps) / F.col("fps")).alias("__by"))
    # At most one row.
    d = cameras.join(F.broadcast(known), how="left")
    scaled = F.col("rate") / F.col("__by") if order == 0 else F.col("rate") * F.col("__by")
    hit = (F.col("ord") != 0) if order == 0 else (F.col("ord") == order)
    return d.select(*(c for c in cameras.columns if c not in ("rate", "fps")), F.when(hit & F.col("__by").isNotNull(), scaled).otherwise(F.col("rate")).alias("rate"), F.when(F.col("ord") == order, F.lit(fps)).otherwise(F.col("fps")).alias("fps"))


def local_coverage(span: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera, first, last) frames of each camera inside a span (lo, hi) of the reference clock; (0, -1) where there are none."""
    d = cameras.join(F.broadcast(span))
    at = lambda c: F.col("rate") * F.col(c) + F.col("offset")
    lo = F.greatest(F.ceil(at("lo") - 1e-9).cast("long"), F.lit(0))
    hi = F.least(F.floor(at("hi") + 1e-9).cast("long"), F.col("n_frames") - 1)
    some = F.coalesce(lo <= hi, F.lit(False))
    return d.select("camera", F.when(some, lo).otherwise(F.lit(0)).alias("first"), F.when(some, hi).otherwise(F.lit(-1)).alias("last"))


def timecode_offsets(cameras: DataFrame) -> DataFrame:
    """(camera, offset) from timecodes in seconds: a camera that started later has a negative offset. Empty unless every camera has one."""
    facts = cameras.agg(F.min(F.when(F.col("ord") == 0, F.col("seconds"))).alias("__zero"), F.count_if(F.col("seconds").isNull()).alias("__none"))
    d = cameras.join(F.broadcast(facts)).where("__none = 0")
    return d.select("camera", F.when(F.col("ord") == 0, F.lit(0.0)).otherwise((F.col("__zero") - F.col("seconds")) * F.col("fps")).alias("offset"))


# ---- landmarks and segments -------------------------------------------------------------------------------------


def landmark_order(landmarks: DataFrame, primary: int = 0) -> DataFrame:
    """(name, ord): the shared list, the primary camera's landmarks first, then further names in camera order."""
    at = F.struct(F.when(F.col("camera") == primary, F.lit(0)).otherwise(F.lit(1)).alias("other"), "camera", "ord")
    first = landmarks.groupBy("name").agg(F.min(at).alias("at"))
    return first.select("name", (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"))


def missing(landmarks: DataFrame, key: Column | None = None) -> DataFrame:
    """(camera, name) that another camera has and this one lacks, compared by ``key`` (the name itself by default)."""
    own = landmarks.withColumn("__key", F.col("name") if key is None else key)
    first = own.groupBy("__key").agg(F.min_by("name", F.struct("camera", "ord")).alias("name"))
    every = own.select("camera").distinct().join(F.broadcast(first))  # cameras times the names of one project
    return every.join(own.select("camera", "__key"), ["camera", "__key"], "left_anti").select("camera", "name")


def missing_segments(segments: DataFrame) -> DataFrame:
    """Animals that a camera lacks; names are compared by their keys."""
    return missing(segments, name_key(F.col("name")))


def synchronized(landmarks: DataFrame, primary: int = 0) -> DataFrame:
    """Every camera with every landmark, in one order."""
    return landmarks.select("camera").distinct().join(F.broadcast(landmark_order(landmarks, primary))).select("camera", "name", "ord")


def changed_cameras(landmarks: DataFrame, primary: int = 0) -> DataFrame:
    """Cameras that ``synchronized`` would change: a name missing or another order."""
    wanted = synchronized(landmarks, primary)
    return wanted.join(landmarks.select("camera", "name", F.col("ord").alias("was")), ["camera", "name"], "left").where(~F.col("was").eqNullSafe(F.col("ord"))).select("camera").distinct()


def reordered(landmarks: DataFrame, names: list[str]) -> DataFrame:
    """Landmarks with the named ones first, in that order; the others follow as they were."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("name")), F.lit(0)), F.lit(len(names) + 1))
    return landmarks.withColumn("ord", F.row_number().over(Window.partitionBy("camera").orderBy(rank, "ord")) - 1)


def assigned(landmarks: DataFrame, names: list[str], animal: str) -> DataFrame:
    """Landmarks with ``animal`` set for the named ones."""
    return landmarks.withColumn("animal", F.when(F.col("name").isin(names), F.lit(animal)).otherwise(F.col("animal")))


def without_segment(landmarks: DataFrame, animal: str, keep_points: bool = False) -> DataFrame:
    """Landmarks after an animal is removed: its points go with it, or stay without an animal."""
    own = name_key(F.coalesce("animal", F.lit(""))) == name_key(F.lit(animal))
    return landmarks.withColumn("animal", F.when(~own, F.col("animal"))) if keep_points else landmarks.where(~own)


# ---- notes and rows ---------------------------------------------------------------------------------------------


def noted(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Notes (camera, frame, text, author) after setting ``fresh`` ones; an empty text clears a frame's note."""
    kept = notes.join(fresh.select("camera", "frame").distinct(), ["camera", "frame"], "left_anti")
    text = F.trim(F.coalesce("text", F.lit("")))
    return kept.unionByName(fresh.withColumn("text", text).where(F.col("text") != "").select(*notes.columns))


def last_tracked(cells: DataFrame) -> DataFrame:
    return cells.groupBy("camera").agg(F.max("frame").alias("last_frame"))


def other_views(observations: DataFrame) -> DataFrame:
    """Adds ``others``: how many other cameras see a landmark at the same instant."""
    return observations.withColumn("others", F.count("*").over(Window.partitionBy("name", "frame")) - 1)


# ---- plans of runs ----------------------------------------------------------------------------------------------


def usable_clicks(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells placed by hand, visible, not hidden and inside the picture."""
    return cells.where(F.col("hand_placed") & F.col("visible") & ~F.col("hidden") & in_frame(F.col("x"), F.col("y"), F.lit(width), F.lit(height)))


def hand_plan(clicks: DataFrame, start: int, end: int, max_gap: int = 2, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """How a run from ``start`` to ``end`` (exclusive) uses clicks: (keys, restart, last, x, y) by stretch.

    A tracker starts again at a stretch's last click and writes up to the frame before the next stretch.
    """
    own = clicks.where((F.col("frame") >= start) & (F.col("frame") < end))
    found = hand_stretches(own, max_gap, keys).where(F.col("end") > start)
    w = Window.partitionBy(*keys).orderBy("start")
    plan = found.select(*keys, F.col("end").alias("restart"), (F.coalesce(F.lead("start").over(w), F.lit(end)) - 1).alias("last"))
    return plan.join(own.select(*keys, F.col("frame").alias("restart"), "x", "y"), [*keys, "restart"])


def first_stop(clicks: DataFrame, start: int, end: int, max_gap: int = 2, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """(keys, last): the last frame that the run's own tracker writes, the one before the first stretch after its start."""
    own = clicks.where((F.col("frame") >= start) & (F.col("frame") < end))
    after = hand_stretches(own, max_gap, keys).where(F.col("end") > start).groupBy(*keys).agg((F.min("start") - 1).alias("last"))
    return clicks.select(*keys).distinct().join(after, list(keys), "left").withColumn("last", F.coalesce("last", F.lit(end - 1)))


def click_motion(clicks: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """(keys, frame, miss, speed) of clicks whose two predecessors are clicked: distance to the constant-velocity prediction.

    The velocity is an even blend of the old one and the last step, started anew after a gap.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    run = F.col("frame") - F.row_number().over(w)
    d = clicks.select(*keys, "frame", "x", "y", run.alias("__run"))
    r = Window.partitionBy(*keys, "__run").orderBy("frame")
    d = d.withColumn("__step", F.struct(*((F.col(c) - F.lag(c).over(r)).alias(c) for c in "xy")))
    d = d.withColumn("__steps", F.when(F.row_number().over(r) > 2, F.collect_list(F.when(F.col("__step.x").isNotNull(), F.col("__step"))).over(r.rowsBetween(-KEPT_STEPS, -1))))

    def blended(c: str) -> Column:
        values = F.transform("__steps", lambda s: s[c])
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, s: KEEP * a + (1 - KEEP) * s)

    d = d.where("__steps is not null").withColumns({"__vx": blended("x"), "__vy": blended("y")})
    return d.select(*keys, "frame", F.hypot(F.col("__step.x") - F.col("__vx"), F.col("__step.y") - F.col("__vy")).alias("miss"), F.hypot("__vx", "__vy").alias("speed"))


def frame_steps(frames: DataFrame, sampled: DataFrame, default: int) -> DataFrame:
    """``frames`` (camera, frame) with the smallest step of the runs (camera, start, end, step) whose grid holds them."""
    grid = sampled.select("camera", "step", F.explode(F.sequence("start", "end", "step")).alias("frame"))
    return frames.join(grid.groupBy("camera", "frame").agg(F.min("step").alias("step")), ["camera", "frame"], "left").withColumn("step", F.coalesce("step", F.lit(default)))


# ---- instants ---------------------------------------------------------------------------------------------------


def sampled_views(cells: DataFrame, cameras: DataFrame, first: int, last: int, shift: Column | None = None) -> DataFrame:
    """(t, camera, name, half, has, lacks): which cameras give a landmark a sample at each reference instant.

    ``half`` is true where only one of the two frames around a fractional instant is there (a gap is never
    bridged). An instant is copied to its one or two frames, so the join is an equi-join by camera and frame.
    """
    at = F.col("rate") * F.col("t") + F.col("offset") + (F.lit(0.0) if shift is None else shift)
    d = F.broadcast(cameras).withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("__at", at)
    d = d.withColumn("__low", F.floor("__at").cast("long"))
    part = F.col("__at") - F.col("__low")
    whole = (part < 1e-9) | (part > 1 - 1e-9)
    frames = F.when(whole, F.array(F.col("__low") + (part > 0.5).cast("long"))).otherwise(F.array(F.col("__low"), F.col("__low") + 1))
    d = d.select("t", "camera", frames.alias("__frames"), F.explode(frames).alias("frame"))
    own = cells.where(exportable(F.lit(True), F.col("hidden"))).select("camera", "name", "frame")
    hit = d.join(own, ["camera", "frame"]).groupBy("t", "camera", "name", "__frames").agg(F.count("*").alias("__n"), F.min("frame").alias("has"))
    half = F.col("__n") < F.size("__frames")
    lacks = F.when(half, F.array_min(F.array_remove("__frames", F.col("has"))))
    return hit.select("t", "camera", "name", half.alias("half"), F.when(half, F.col("has")).alias("has"), lacks.alias("lacks"))


def stable_cells(cells: DataFrame, cameras: DataFrame, first: int, last: int, reach: float) -> DataFrame:
    """(t, camera, name) with data at an instant and at every probe within ``reach`` frames, at most a frame apart; the reference isn't moved."""
    m = 1 if reach < 2 else -int(-reach // 1)
    probes = [reach * k / m for k in range(-m, m + 1)]
    shifted = cameras.withColumn("__shift", F.explode(F.array(*map(F.lit, probes)))).withColumn("offset", F.col("offset") + F.when(F.col("ord") != 0, F.col("__shift")).otherwise(F.lit(0.0)))
    keyed = shifted.withColumn("camera", F.struct("camera", "__shift"))
    own = cells.join(F.broadcast(shifted.select("camera", "__shift")), "camera").withColumn("camera", F.struct("camera", "__shift"))
    seen = sampled_views(own, keyed, first, last).where("not half")
    return seen.groupBy("t", F.col("camera.camera").alias("camera"), "name").agg(F.count("*").alias("n")).where(F.col("n") == len(probes)).drop("n")


def shared_pairs(both: DataFrame) -> DataFrame:
    """(a, b, n): how many instants (camera, t) two cameras share."""
    other = both.select("t", F.col("camera").alias("b"))
    return both.select("t", F.col("camera").alias("a")).join(other, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def camera_groups(both: DataFrame, least: int) -> DataFrame:
    """(camera, group): cameras joined, directly or through others, by at least ``least`` shared instants; a group is named by its first camera.

    Links are counted in Spark; a project has a handful of cameras, so their groups are closed by joining links
    with themselves until nothing is new.
    """
    names = both.select("camera").distinct()
    near = shared_pairs(both).where(F.col("n") >= least)
    pairs = [(r.a, r.b) for r in near.select("a", "b").collect()]  # at most one row for each two cameras of a project
    group = {r.camera: r.camera for r in names.collect()}
    for a, b in sorted(pairs):
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {c: new if g == old else g for c, g in group.items()}
    return both.sparkSession.createDataFrame(list(group.items()), "camera string, `group` string")


def camera_ticks(both: DataFrame, least: int) -> DataFrame:
    """(camera, instants, shared, ticked): a camera is ticked if it shares enough instants with others."""
    d = both.withColumn("__others", F.count("*").over(Window.partitionBy("t")) - 1)
    found = d.groupBy("camera").agg(F.count("*").alias("instants"), F.count_if(F.col("__others") > 0).alias("shared"))
    return found.withColumn("ticked", F.col("shared") >= least)


# ---- reports and exports ------------------------------------------------------------------------------------------


def outlier_limits(errors: DataFrame, floor: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, limit): three times the median error, never below ``floor``."""
    middle = medians(errors, F.col("error"), keys)
    groups = errors.select(*keys).distinct()
    same = [groups[k].eqNullSafe(middle[k]) for k in keys]
    limit = F.greatest(F.lit(floor), F.coalesce(3 * F.col("median"), F.lit(0.0))).alias("limit")
    return groups.join(middle, same, "left").select(*(groups[k] for k in keys), limit)


def kinematics(moving: DataFrame, width: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Frames, peak and median speed and peak acceleration of each landmark, without the first and last ``width`` frames of a run.

    ``moving`` holds ``edge`` and the derivatives of all coordinates.
    """
    norm = lambda p: F.sqrt(sum(F.col(f"{p}_{c}") * F.col(f"{p}_{c}") for c in "xyz" if f"{p}_{c}" in moving.columns))
    inner = ~F.col("edge")
    d = moving.withColumns({"__s": F.when(inner, norm("v")), "__a": F.when(inner, norm("a"))})
    d = written(d.select(*keys, "__s", "__a"), "speeds")
    peaks = d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__s").alias("peak_speed"), F.max("__a").alias("peak_acceleration"))
    middle = medians(d, F.col("__s"), keys, "median_speed")
    same = [peaks[k].eqNullSafe(middle[k]) for k in keys]
    return peaks.join(middle, same, "left").select(*(peaks[k] for k in keys), "n", "peak_speed", "median_speed", "peak_acceleration")


def flagged_cells(errors: DataFrame, stretches: DataFrame, threshold: float) -> DataFrame:
    """One row: cells inside the stretches (cam, name, start, end) with an error, their median, largest, and how many are over ``threshold``."""
    keys = stretches.select("cam", "name", F.explode(F.sequence("start", "end")).alias("frame")).distinct()
    d = written(errors.join(keys, ["cam", "name", "frame"], "left_semi").select("error"), "flagged")
    totals = d.agg(F.count("error").alias("n_cells"), F.max("error").alias("max_error"), F.count_if(F.col("error") > threshold).alias("n_over"))
    return totals.join(medians(d, F.col("error"), name="median_error")).select("n_cells", "median_error", "max_error", "n_over")


def setting_problems(infos: DataFrame, settings: list[str], key: str, ratio: float = 2.0, speed: str | None = None) -> DataFrame:
    """(key, setting) of settings that differ inside a rig, and ``speed`` where its extremes differ by ``ratio`` or more."""
    differ = [F.when(F.count_distinct(s) > 1, F.lit(s)) for s in settings]
    if speed:
        good = F.when(F.col(speed) > 0, F.col(speed))
        differ.append(F.when(F.max(good) / F.min(good) >= ratio, F.lit(speed)))
    return infos.groupBy(key).agg(F.array_compact(F.array(*differ)).alias("__d")).select(key, F.explode("__d").alias("setting"))


def all_cameras(cells: DataFrame, cameras: DataFrame, frames: int, height: int, flip: bool = False) -> DataFrame:
    """(frame, camera, name, x, y): all cameras at each frame of the reference, at their nearest whole frame, first pixel 1.

    A reference frame is copied to each camera's nearest frame; the join is by camera and frame.
    """
    spine = cameras.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("__local", half_up(F.col("rate") * F.col("frame") + F.col("offset")))
    own = cells.where(exportable(F.lit(True), F.col("hidden"))).select("camera", F.col("frame").alias("__local"), "name", "x", "y")
    y = F.lit(height) - F.col("y") if flip else F.col("y") + 1
    return F.broadcast(spine).join(own, ["camera", "__local"]).select("frame", "camera", F.col("ord"), "name", (F.col("x") + 1).alias("x"), y.alias("y"))


def all_cameras_wide(rows: DataFrame, names: list[str], cameras: int) -> DataFrame:
    """One row a reference frame, with columns ``pt<i>_cam<k>_X`` and ``_Y`` in the order of ``names`` and cameras."""
    cell = lambda i, k, c: F.max(F.when((F.col("name") == names[i]) & (F.col("ord") == k), F.col(c)))
    return rows.groupBy("frame").agg(*(cell(i, k, c).alias(f"pt{i + 1}_cam{k + 1}_{c.upper()}") for i in range(len(names)) for k in range(cameras) for c in "xy"))
