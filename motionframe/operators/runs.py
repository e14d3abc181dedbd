"""Runs (gaps and islands), derivatives that never cross a gap, and other ordered analytics.

All window functions partition by series (camera and name, or fewer columns) and order by frame, so one
shuffle by series serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("camera", "name")


def _by(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("frame")


def with_run(df: DataFrame, keys: tuple[str, ...] = SERIES, max_gap: int = 0) -> DataFrame:
    """Adds ``run``: its first frame. A run goes on while no more than ``max_gap`` frames are missing."""
    step = F.col("frame") - F.lag("frame").over(_by(keys))
    start = F.when(step.isNull() | (step > max_gap + 1), F.col("frame"))
    return df.withColumn("run", F.last(start, ignorenulls=True).over(_by(keys).rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, keys: tuple[str, ...] = SERIES, max_gap: int = 0, least: int = 1) -> DataFrame:
    """(keys, start, end, n): runs measured end to end, of at least ``least`` frames."""
    out = with_run(df.select(*keys, "frame").distinct(), keys, max_gap).groupBy(*keys, "run")
    out = out.agg(F.max("frame").alias("end"), F.count("*").alias("n")).withColumnRenamed("run", "start")
    return out.where(F.col("end") - F.col("start") + 1 >= least).select(*keys, "start", "end", "n")


def low_confidence_runs(df: DataFrame, threshold: float, keys: tuple[str, ...] = ("camera",)) -> DataFrame:
    """Runs of frames in which any exportable point is below ``threshold``."""
    low = df.where(~F.col("hidden")).groupBy(*keys, "frame").agg(F.bool_or(F.col("confidence") < threshold).alias("low")).where("low")
    return runs(low, keys)


def next_run(found: DataFrame, frame: int, forward: bool = True, keys: tuple[str, ...] = ("camera",)) -> DataFrame:
    """The nearest run that starts after (ends before) a frame."""
    if forward:
        return found.where(F.col("start") > frame).groupBy(*keys).agg(F.min(F.struct("start", "end")).alias("r")).select(*keys, "r.*")
    return found.where(F.col("end") < frame).groupBy(*keys).agg(F.max(F.struct("start", "end")).alias("r")).select(*keys, "r.*")


def next_hand_placed(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """For every cell the neighbouring hand-placed frames of its series."""
    hand = F.when(F.col("hand_placed"), F.col("frame"))
    before = F.last(hand, ignorenulls=True).over(_by(keys).rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(hand, ignorenulls=True).over(_by(keys).rowsBetween(1, Window.unboundedFollowing))
    return df.select(*keys, "frame", before.alias("previous_hand"), after.alias("next_hand"))


def edge_mask(df: DataFrame, width: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds ``edge``: whether a frame is among the first or last ``width`` of its run."""
    d = with_run(df, keys)
    end = F.max("frame").over(Window.partitionBy(*keys, "run"))
    return d.withColumn("edge", (F.col("frame") - F.col("run") < width) | (end - F.col("frame") < width))


def _slope(value: str, dt: float, w, i: Column, n: Column) -> Column:
    lag, lead = (lambda k: F.lag(value, k).over(w)), (lambda k: F.lead(value, k).over(w))
    v = F.col(value)
    return (
        F.when(n == 1, F.lit(None).cast("double"))
        .when(n == 2, F.when(i == 1, lead(1) - v).otherwise(v - lag(1)) / dt)
        .when(i == 1, (-3 * v + 4 * lead(1) - lead(2)) / (2 * dt))
        .when(i == n, (3 * v - 4 * lag(1) + lag(2)) / (2 * dt))
        .otherwise((lead(1) - lag(1)) / (2 * dt))
    )


def derivatives(df: DataFrame, fps: float, values: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds ``v_<value>`` and ``a_<value>``: central differences in runs, second-order one-sided ones at their ends.

    A run of two frames has a velocity only, a single frame neither.
    """
    d = with_run(df, keys)
    w = Window.partitionBy(*keys, "run").orderBy("frame")
    d = d.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*keys, "run"))})
    d = d.withColumns({f"v_{c}": _slope(c, 1 / fps, w, F.col("__i"), F.col("__n")) for c in values})
    d = d.withColumns({f"a_{c}": F.when(F.col("__n") > 2, _slope(f"v_{c}", 1 / fps, w, F.col("__i"), F.col("__n"))) for c in values})
    return d.drop("__i", "__n")


def angular_velocity(df: DataFrame, value: str, fps: float, step: Column | int = 1, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds ``rate``: difference between the nearest measured neighbours, each no farther than the larger of both steps."""
    d = df.where(F.col(value).isNotNull()).withColumn("__step", F.lit(step) if isinstance(step, int) else step)
    w = _by(keys)
    here = {"f": F.col("frame"), "v": F.col(value)}

    def side(fn) -> dict[str, Column]:
        near = F.abs(fn("frame").over(w) - F.col("frame")) <= F.greatest("__step", fn("__step").over(w))
        return {"f": F.when(near, fn("frame").over(w)), "v": F.when(near, fn(value).over(w))}

    a, b = side(F.lag), side(F.lead)
    lo = {k: F.coalesce(a[k], here[k]) for k in here}
    hi = {k: F.coalesce(b[k], here[k]) for k in here}
    rate = F.try_divide((hi["v"] - lo["v"]) * fps, (hi["f"] - lo["f"]).cast("double"))
    return d.withColumn("rate", rate).drop("__step")


def gap_plan(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """(keys, start, end, reason) of every gap between two cells of a series: ``fill``, or why it is left open."""
    w = _by(keys)
    before = {c: F.lag(c).over(w) for c in ("frame", "hand_placed", "hidden", "visible")}
    d = df.select(*keys, (before["frame"] + 1).alias("start"), (F.col("frame") - 1).alias("end"), before["hand_placed"].alias("h0"), F.col("hand_placed").alias("h1"), before["hidden"].alias("hid"), before["visible"].alias("vis"))
    reason = F.when(F.col("hid"), "hidden").when(F.col("h0") & F.col("h1"), "between clicks").when(~F.col("vis"), "not visible").otherwise("fill")
    return d.where("start <= end").select(*keys, "start", "end", reason.alias("reason"))


def hand_stretches(df: DataFrame, max_gap: int = 2, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Runs of hand-placed frames with at most ``max_gap`` frames missing inside."""
    return runs(df.where("hand_placed"), keys, max_gap)


def longest_stretch(df: DataFrame, max_gap: int = 2, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """The hand-placed stretch with most frames, the first of equals."""
    best = F.max(F.struct(F.col("n").alias("n"), (-F.col("start")).alias("back"), F.col("end").alias("end"))).alias("b")
    return hand_stretches(df, max_gap, keys).groupBy(*keys).agg(best).select(*keys, (-F.col("b.back")).alias("start"), F.col("b.end").alias("end"), F.col("b.n").alias("n"))


def timeline(df: DataFrame, frames: int, columns: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """One row for each series and column of a timeline ``columns`` wide: a tumbling-bucket summary of flags."""
    bucket = F.floor(F.col("frame") * columns / frames).cast("long")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min(F.when(~F.col("hidden"), F.col("confidence"))).alias("min_confidence"),
        F.bool_or("hand_placed").alias("any_hand"), F.bool_or("hidden").alias("any_hidden"),
    )


def detrended(df: DataFrame, value: str, half: int = 15, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Adds ``clean``: the value minus its centred moving average (ends padded with the end values), as a z-score.

    NULLs count as the series' median.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("frame")
    d = df.withColumn("__v", F.coalesce(F.col(value), F.median(value).over(whole)))
    d = d.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(whole), "__a": F.first("__v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__b": F.last("__v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    total = F.sum("__v").over(w.rowsBetween(-half, half))
    pad = F.greatest(half + 1 - F.col("__i"), F.lit(0)) * F.col("__a") + F.greatest(half - (F.col("__n") - F.col("__i")), F.lit(0)) * F.col("__b")
    d = d.withColumn("__h", F.col("__v") - (total + pad) / (2 * half + 1))
    z = F.try_divide(F.col("__h") - F.avg("__h").over(whole), F.stddev_pop("__h").over(whole))
    return d.withColumn("clean", F.coalesce(z, F.lit(0.0))).drop("__v", "__i", "__n", "__a", "__b", "__h")


def evenly_thinned(df: DataFrame, k: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """``k`` rows of each series spread evenly from the first to the last (all, if there are fewer)."""
    w = _by(keys)
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys))
    d = df.withColumns({"__i": i, "__n": n})
    if k == 1:
        return d.where("__i = 0").drop("__i", "__n")
    slot = F.floor((F.col("__i") * (k - 1)) / F.greatest(F.col("__n") - 1, F.lit(1)))
    first = F.ceil(slot * (F.col("__n") - 1) / (k - 1))
    return d.where((F.col("__n") <= k) | (F.col("__i") == first)).drop("__i", "__n")
