"""Verdicts over small measured tables: re-tracked cells before and after, frame shifts, settings, tilts, names' clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import score_to_confidence
from motionframe.operators.quantiles import medians

# A median under BETTER or over WORSE times the old one is a change.
BETTER, WORSE = 0.7, 1.3
# Distance over which no picture matches, least gap between best and next, ratios for clear and leaning.
NO_MATCH, LEAST_GAP, CLEAR, LEAN = 0.20, 0.004, 3.0, 1.2
# Degrees from the usual tilt, seconds of a bucket, samples needed.
TILT, BUCKET, LEAST_SAMPLES = 0.5, 0.25, 4


def retrack_verdicts(before: DataFrame, after: DataFrame, cell: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """(keys, n, lost, before, after, verdict) from the errors of the same flagged cells before and after.

    A cell that lost its value makes its group worse whatever the medians say; medians compare cells that
    have a value both times.
    """
    d = before.select(*cell, F.col("error").alias("b")).join(after.select(*cell, F.col("error").alias("a")), list(cell), "left")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    counts = d.groupBy(*keys).agg(F.count_if(F.col("b").isNotNull()).alias("n"), F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("lost"))
    old, new = (medians(d, F.when(both, F.col(c)), keys, name) for c, name in (("b", "before"), ("a", "after")))
    ratio = lambda r: F.lit(r) * F.col("before")
    said = F.when(F.col("lost") > 0, "worse").when(F.col("before").isNull(), "same").when(F.col("after") < ratio(BETTER), "better").when(F.col("after") > ratio(WORSE), "worse").otherwise("same")
    return counts.join(old, list(keys), "left").join(new, list(keys), "left").withColumn("verdict", said)


def judged_shifts(distances: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, shift, verdict) from (keys, shift, distance), a handful of tried shifts for each moment.

    The nearest shift wins, at ties the smaller one, and then the negative one.
    """
    best = F.array_sort(F.collect_list(F.struct("distance", F.abs("shift").alias("size"), "shift"))).alias("s")
    d = distances.groupBy(*keys).agg(best)
    first, then = F.get("s", F.lit(0)), F.get("s", F.lit(1))["distance"]
    b = first["distance"]
    said = (
        F.when(b > NO_MATCH, "none").when(then.isNull() | (then - b < LEAST_GAP), "unclear")
        .when(then >= CLEAR * b, "clear").when(then >= LEAN * b, "lean").otherwise("unclear")
    )
    return d.select(*keys, first["shift"].alias("shift"), said.alias("verdict"))


def tilt_moves(samples: DataFrame, key: str) -> DataFrame:
    """(key, start, end, tilt) stretches in which a recording's gravity leaves its median direction.

    ``samples`` are (key, t, gx, gy, gz). Means of quarter-second buckets are judged; empty buckets don't end a stretch.
    """
    axes = ("gx", "gy", "gz")
    usual = samples.groupBy(key).agg(F.min("t").alias("t0"), F.count("*").alias("n"))
    for a in axes:
        usual = usual.join(medians(samples, F.col(a), (key,), f"m{a}"), key)
    d = samples.join(usual.where(F.col("n") >= LEAST_SAMPLES), key).withColumn("k", F.floor((F.col("t") - F.col("t0")) / BUCKET))
    means = d.groupBy(key, "k", "t0", *(f"m{a}" for a in axes)).agg(*(F.avg(a).alias(a) for a in axes))
    dot = sum((F.col(a) * F.col(f"m{a}") for a in axes), F.lit(0.0))
    size = lambda p: F.sqrt(sum((F.col(f"{p}{a}") * F.col(f"{p}{a}") for a in axes), F.lit(0.0)))
    off = F.degrees(F.acos(F.greatest(F.least(dot / F.greatest(size("") * size("m"), F.lit(1e-9)), F.lit(1.0)), F.lit(-1.0))))
    w = Window.partitionBy(key).orderBy("k")
    d = means.withColumn("off", off).withColumn("g", F.count_if(F.col("off") <= TILT).over(w)).where(F.col("off") > TILT)
    return d.groupBy(key, "g").agg(
        F.min(F.col("t0") + F.col("k") * BUCKET).alias("start"), F.max(F.col("t0") + (F.col("k") + 1) * BUCKET).alias("end"), F.max("off").alias("tilt")
    ).drop("g")


def _order(error: Column, corrections: Column, drifts: Column, median: Column) -> list[Column]:
    bad, inf = F.coalesce(error, F.lit("")) != "", F.lit(float("inf"))
    value = F.when(~bad & median.isNotNull() & ~F.isnan(median), median).otherwise(inf)
    return [bad.cast("int").alias("bad"), F.when(bad, 10**9).otherwise(corrections).alias("c"), F.when(bad, 10**9).otherwise(drifts).alias("d"), value.alias("m")]


def best_settings(results: DataFrame, keys: tuple[str, ...] = ("cue",)) -> DataFrame:
    """For each cue the result with the fewest corrections, then drifts, then the least median error; ``ord`` settles ties."""
    order = F.struct(*_order(F.col("error"), F.col("corrections"), F.col("drifts"), F.col("median_error")), F.col("ord"))
    return results.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in results.columns if c not in keys)), order).alias("r")).select(*keys, "r.*")


def recommended(results: DataFrame, preference: list[str]) -> DataFrame:
    """The winning result without an error; medians equal to a tenth are a tie that the model's preference settles, then ``ord``."""
    bad, c, d, m = _order(F.col("error"), F.col("corrections"), F.col("drifts"), F.col("median_error"))
    rank = F.coalesce(F.array_position(F.lit(preference), F.col("model")), F.lit(0))
    order = F.struct(c, d, F.bround(m, 1), F.when(rank > 0, rank).otherwise(len(preference) + 1).alias("p"), F.col("ord"))
    return results.where(F.coalesce("error", F.lit("")) == "").agg(F.min_by(F.struct(*results.columns), order).alias("r")).where("r IS NOT NULL").select("r.*")


def name_clock_offsets(cameras: DataFrame) -> DataFrame:
    """``offset`` in frames from the recording stamps (YYYYMMDD_HHMMSS) in files' names, against the camera of order 0; NULL without a stamp."""
    file = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    stamp = F.try_to_timestamp(F.concat(F.regexp_extract(file, r"([0-9]{8})_([0-9]{6})", 1), F.regexp_extract(file, r"([0-9]{8})_([0-9]{6})", 2)), F.lit("yyyyMMddHHmmss"))
    d = cameras.withColumn("__s", F.unix_timestamp(stamp))
    zero = d.where("ord = 0").agg(F.max("__s")).scalar()
    return d.withColumn("offset", -(F.col("__s") - zero) * F.col("fps").cast("double")).drop("__s")


def mask_boxes(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Tight box of each mask's pixels (keys, x, y)."""
    return pixels.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def ball_confidence(quality: Column, score: Column) -> Column:
    return F.greatest(F.least(quality, F.lit(1.0)), F.lit(0.0)) * score_to_confidence(score)


def person_scores(frames: DataFrame, keys: tuple[str, ...] = ("person",)) -> DataFrame:
    """Mean detector score of each person over frames whose box the detector found (or whose source is unknown); NULL without any."""
    found = F.col("score").isNotNull() & ~F.isnan("score") & F.coalesce(F.col("source"), F.lit("unknown")).isin("detector", "unknown")
    return frames.groupBy(*keys).agg(F.avg(F.when(found, F.col("score"))).alias("score"), F.count_if(found).alias("detected"), F.count_if(F.col("posed")).alias("posed"))
