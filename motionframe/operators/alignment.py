"""Clocks of several cameras: time mapping, interval and nearest joins, coverage, common instants, lag search.

A camera's frame at reference time t is ``rate * t + offset``. The interval join gives the value at a
fractional frame from both neighbours and never bridges a gap; instead of exploding a spine of instants and
joining it, every cell is copied to the few instants it can serve, so that one shuffle does the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import half_up, map_index

WHOLE = 1e-9


def on_reference(cells: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cells with their nearest reference frame (``reference_frame``) by the tie rule for mapping back."""
    d = cells.join(F.broadcast(cameras), "camera")
    x = (F.col("frame") - F.col("offset")) / F.col("rate")
    return d.withColumn("reference_frame", map_index(x, F.col("ord"), F.lit(0)))


def mapped(cells: DataFrame, cameras: DataFrame, target: str, frames: int | None = None) -> DataFrame:
    """Cells with the whole frame of camera ``target`` nearest to them; NULL outside its recording."""
    dst = cameras.where(F.col("camera") == target).select(F.col("offset").alias("o"), F.col("rate").alias("r"), F.col("ord").alias("k"))
    d = cells.join(F.broadcast(cameras), "camera").join(F.broadcast(dst))
    x = F.col("r") * ((F.col("frame") - F.col("offset")) / F.col("rate")) + F.col("o")
    to = map_index(x, F.col("ord"), F.col("k"))
    return d.withColumn("target_frame", to if frames is None else F.when((to >= 0) & (to < frames), to)).drop("o", "r", "k")


def sampled(cells: DataFrame, cameras: DataFrame, values: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """(camera, by, name, t, values): linear interpolation at every whole reference instant t.

    ``by`` names columns of ``cameras`` that tell several clocks of one camera apart. A fraction within 1e-9 of a whole frame is that frame; otherwise both neighbours must be there.
    """
    d = cells.join(F.broadcast(cameras), "camera")
    lo = F.ceil((F.col("frame") - 1 - F.col("offset")) / F.col("rate") - 1e-6).cast("long")
    hi = F.floor((F.col("frame") + 1 - F.col("offset")) / F.col("rate") + 1e-6).cast("long")
    d = d.withColumn("t", F.explode(F.sequence(lo, hi)))
    f = F.col("rate") * F.col("t") + F.col("offset")
    near = F.floor(f + 0.5)
    whole = F.abs(f - near) < WHOLE
    part = f - F.floor(f)
    weight = F.when(whole, F.when(F.col("frame") == near, 1.0)).when(F.col("frame") == F.floor(f), 1 - part).when(F.col("frame") == F.floor(f) + 1, part)
    d = d.withColumns({"w": weight, "whole": whole}).where("w is not null")
    sums = [F.sum(F.col("w") * F.col(v)).alias(v) for v in values]
    got = d.groupBy("camera", *by, "name", "t").agg(*sums, F.count("*").alias("n"), F.bool_or("whole").alias("whole"))
    return got.where("whole or n = 2").select("camera", *by, "name", "t", *values)


def nearest(cells: DataFrame, instants: DataFrame, reach: int = 3) -> DataFrame:
    """For each (camera, name, t) of ``instants`` the nearest cell within ``reach`` frames; of two as near, the later."""
    near = cells.withColumn("t", F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)))
    d = instants.join(near, ["camera", "name", "t"])
    best = F.min_by(F.struct("frame", "x", "y"), F.struct(F.abs(F.col("frame") - F.col("t")), -F.col("frame"))).alias("b")
    return d.groupBy("camera", "name", "t").agg(best).select("camera", "name", "t", "b.*")


def observed(cells: DataFrame, cameras: DataFrame) -> DataFrame:
    """At every reference instant the interpolated value, else that of the nearest whole frame (``exact`` false)."""
    lerp = sampled(cells, cameras).withColumn("exact", F.lit(True))
    d = cells.join(F.broadcast(cameras), "camera")
    span = F.ceil(1 / F.col("rate")).cast("long") + 1
    around = half_up((F.col("frame") - F.col("offset")) / F.col("rate"))
    d = d.withColumn("t", F.explode(F.sequence(around - span, around + span)))
    d = d.where(half_up(F.col("rate") * F.col("t") + F.col("offset")) == F.col("frame")).select("camera", "name", "t", F.col("x").alias("nx"), F.col("y").alias("ny"))
    both = d.join(lerp, ["camera", "name", "t"], "full")
    return both.select("camera", "name", "t", F.coalesce("x", "nx").alias("x"), F.coalesce("y", "ny").alias("y"), F.coalesce("exact", F.lit(False)).alias("exact"))


def common_names(cells: DataFrame, least: int) -> DataFrame:
    """Names with data in at least ``least`` cameras."""
    return cells.groupBy("name").agg(F.countDistinct("camera").alias("cameras")).where(F.col("cameras") >= least)


def shared_instants(samples: DataFrame, least: int) -> DataFrame:
    """(name, t, cameras) seen by at least ``least`` cameras."""
    return samples.groupBy("name", "t").agg(F.count("*").alias("cameras")).where(F.col("cameras") >= least)


def pairs_seen(samples: DataFrame, a: str, b: str) -> DataFrame:
    """Instants at which a camera sees both of two landmarks, with the cameras that do so at once."""
    both = samples.where(F.col("name").isin(a, b)).groupBy("camera", "t").agg(F.countDistinct("name").alias("k")).where("k = 2")
    return both.select("camera", "t", F.count("*").over(Window.partitionBy("t")).alias("cameras"))


def best_common_instant(samples: DataFrame, names: list[str], least: int) -> DataFrame:
    """The earliest instant at which every name is seen by at least ``least`` cameras (relational division)."""
    seen = shared_instants(samples.where(F.col("name").isin(names)), least)
    return seen.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") == len(names)).agg(F.min("t").alias("t"))


def coverage(cells: DataFrame, a: str, b: str) -> DataFrame:
    """For each camera the frames with both and with any of two landmarks."""
    per = cells.where(F.col("name").isin(a, b)).groupBy("camera", "frame").agg(F.countDistinct("name").alias("k"))
    return per.groupBy("camera").agg(F.count_if(F.col("k") == 2).alias("both"), F.count("*").alias("either"))


def spans(cells: DataFrame, cameras: DataFrame) -> DataFrame:
    """(camera, lo, hi) on the reference clock."""
    d = cells.groupBy("camera").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).join(F.broadcast(cameras), "camera")
    at = lambda c: (F.col(c) - F.col("offset")) / F.col("rate")
    return d.select("camera", at("a").alias("lo"), at("b").alias("hi"))


def covered_span(intervals: DataFrame, least: int) -> DataFrame:
    """First and last instant covered by at least ``least`` intervals: a sweep in which starts come before ends."""
    up = intervals.select(F.col("lo").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("d"))
    down = intervals.select(F.col("hi").alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("d"))
    before = F.sum("d").over(Window.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1))
    swept = up.union(down).withColumn("before", F.coalesce(before, F.lit(0))).withColumn("after", F.col("before") + F.col("d"))
    first = F.min(F.when((F.col("after") >= least) & (F.col("before") < least), F.col("t")))
    last = F.max(F.when((F.col("before") >= least) & (F.col("after") < least), F.col("t")))
    return swept.agg(first.alias("lo"), last.alias("hi"))


def windows(intervals: DataFrame) -> DataFrame:
    """The window that all cameras share and the one that any covers."""
    return intervals.agg(F.max("lo").alias("shared_lo"), F.min("hi").alias("shared_hi"), F.min("lo").alias("any_lo"), F.max("hi").alias("any_hi"))


def missing_names(cells: DataFrame) -> DataFrame:
    """(camera, name) that another camera has and this one lacks."""
    have = cells.select("camera", "name").distinct()
    every = have.select("camera").distinct().crossJoin(F.broadcast(have.select("name").distinct()))  # two small dimensions
    return every.join(have, ["camera", "name"], "left_anti")


def lag_scores(reference: DataFrame, other: DataFrame, max_lag: int, least: int = 16, share: float = 0.1) -> DataFrame:
    """(lag, n, r): normalised correlation of two series (frame, v) at every lag with enough overlap: ``least`` samples and a share of the shorter series.

    Each sample is copied to the instants it meets, so one equi-join covers all lags.
    """
    b = other.select(F.col("frame").alias("f2"), F.col("v").alias("b")).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    d = reference.select("frame", F.col("v").alias("a")).join(b.withColumn("frame", F.col("f2") - F.col("lag")), "frame")
    score = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))))
    shorter = F.least(reference.agg(F.count("*")).scalar(), other.agg(F.count("*")).scalar())
    return d.groupBy("lag").agg(F.count("*").alias("n"), score.alias("r")).where(F.col("n") >= F.greatest(F.lit(least), F.floor(share * shorter)))


def lag_verdict(scores: DataFrame, rivals: int = 3) -> DataFrame:
    """(lag, part, r, margin, verdict): the best lag, the fraction by which a parabola through it and its neighbours peaks beside it, and how far it stands above all others at least ``rivals`` away (above 0, if there is none)."""
    best = scores.agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("best"), F.max("r").alias("top"))
    d = scores.where("r is not null").join(F.broadcast(best))
    beside = lambda k: F.max(F.when(F.col("lag") == F.col("best") + k, F.col("r")))
    second = F.max(F.when(F.abs(F.col("lag") - F.col("best")) >= rivals, F.col("r")))
    got = d.agg(F.first("best").alias("lag"), F.first("top").alias("r"), second.alias("second"), beside(-1).alias("before"), beside(1).alias("after"))
    bend = F.col("before") - 2 * F.col("r") + F.col("after")
    part = F.when(bend < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (F.col("before") - F.col("after")) / 2 / bend)))
    margin = F.col("r") - F.coalesce("second", F.lit(0.0))
    verdict = F.when((F.col("r") >= 0.45) & (margin >= 0.12), "clear").when((F.col("r") >= 0.25) & (margin >= 0.05), "weak").otherwise("none")
    return got.select("lag", F.coalesce(part, F.lit(0.0)).alias("part"), "r", margin.alias("margin"), verdict.alias("verdict"))


def resampled(signal: DataFrame, rate: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Series (keys, frame, v) linearly resampled to instants ``frame / rate``; both neighbours must be there."""
    lo, hi = F.ceil((F.col("frame") - 1) / rate).cast("long"), F.floor((F.col("frame") + 1) / rate).cast("long")
    d = signal.withColumn("t", F.explode(F.sequence(lo, hi)))
    f = rate * F.col("t")
    part, whole = f - F.floor(f), F.abs(f - F.floor(f + 0.5)) < WHOLE
    w = F.when(whole, F.when(F.col("frame") == F.floor(f + 0.5), 1.0)).when(F.col("frame") == F.floor(f), 1 - part).when(F.col("frame") == F.floor(f) + 1, part)
    got = d.withColumns({"w": w, "whole": whole}).where("w is not null").groupBy(*keys, "t").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count("*").alias("n"), F.bool_or("whole").alias("whole"))
    return got.where("whole or n = 2").select(*keys, F.col("t").alias("frame"), "v")
