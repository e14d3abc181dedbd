"""Free falls found from the pictures alone, without calibration: release, flight, and bounce, landing or catch.

Within each stretch of instants that two cameras see, a landmark's speed is the median over its cameras, in
units of what counts as still. All steps are windows over the stretch in order of time, so a stretch streams
through a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.operators.quantiles import medians
from motionframe.sources.scratch import written

#: A still picture speed as a share of the long side and at least in pixels, moving steps of a release, frames of rest before it that are left out, fast steps that can end.
STILL_SHARE, LEAST_STILL, RELEASE, REST, FAST = 0.0008, 1.0, 3, 4, 2.0


def _steps(samples: DataFrame, cameras: DataFrame) -> DataFrame:
    """(name, run, k, t, s, turn): step k of a run goes from instant t to t + 1; ``s`` is its speed, ``turn`` the cosine to the step after it."""
    size = F.greatest(F.col("width"), F.col("height"))
    still = F.greatest(F.lit(LEAST_STILL), STILL_SHARE * size)
    d = samples.join(F.broadcast(cameras.select("camera", still.alias("still"))), "camera")
    seen = d.groupBy("name", "t").agg(F.count("*").alias("n")).where("n >= 2")
    w = Window.partitionBy("name").orderBy("t")
    instants = seen.withColumn("run", F.col("t") - F.row_number().over(w)).select("name", "t", "run")
    own = d.join(instants, ["name", "t"])
    track = Window.partitionBy("camera", "name", "run").orderBy("t")
    ahead = lambda c, k=1: F.lead(c, k).over(track)
    step = own.withColumns({"vx": F.when(ahead("t") == F.col("t") + 1, ahead("x") - F.col("x")), "vy": F.when(ahead("t") == F.col("t") + 1, ahead("y") - F.col("y"))})
    then = lambda c: F.when(ahead("t") == F.col("t") + 1, ahead(c))
    step = step.withColumns({"wx": then("vx"), "wy": then("vy")})
    cos = F.try_divide(F.col("vx") * F.col("wx") + F.col("vy") * F.col("wy"), F.hypot("vx", "vy") * F.hypot("wx", "wy"))
    # A group holds the cameras of one instant.
    speeds = step.groupBy("name", "run", "t").agg(F.median(F.hypot("vx", "vy") / F.col("still")).alias("s"), F.median(cos).alias("turn"))
    whole = Window.partitionBy("name", "run")
    order = whole.orderBy("t")
    d = speeds.withColumns({"k": F.row_number().over(order) - 1, "n": F.count("*").over(whole)})
    return d


def falls(samples: DataFrame, cameras: DataFrame, least: int = 6) -> DataFrame:
    """(name, first, last, rest_left_out, end_left_out, travel): the free fall of each landmark with most picture travel.

    ``samples`` (camera, name, t, x, y) have one row for each instant a camera sees a landmark, ``cameras`` the
    width and height. A fall starts at the release: three moving steps in a row; of at least four frames of rest
    before it, two stay. It ends at a step without speed, one at which a fast landmark stops or halves its speed, or
    turns back. At least ``least`` frames and a median speed of twice the still one are asked for; of equal
    travels the earlier one counts. Landmarks without a fall have no row.
    """
    d = _steps(samples, cameras)
    whole = Window.partitionBy("name", "run")
    order = whole.orderBy("t")
    moving = lambda c: F.coalesce(c >= 1, F.lit(False))
    released = F.lit(True)
    for j in range(RELEASE):
        released = released & (moving(F.col("s")) if j == 0 else F.coalesce(moving(F.lead("s", j).over(order)), F.lit(False)))
    # The last row of a run starts no step.
    d = d.withColumn("__go", released & (F.col("k") + RELEASE < F.col("n")))
    d = d.withColumn("m", F.min(F.when(F.col("__go"), F.col("k"))).over(whole)).where("m is not null")
    before, turned = F.lag("s").over(order), F.lag("turn").over(order)
    stops = F.col("s").isNull() | ((before >= FAST) & ((F.col("s") < 1) | (F.col("s") < 0.5 * before) | (turned < 0)))
    d = d.withColumn("__end", F.coalesce(stops, F.lit(False)) & (F.col("k") > F.col("m")) & (F.col("k") < F.col("n") - 1))
    d = d.withColumn("__last", F.min(F.when(F.col("__end"), F.col("k"))).over(whole))
    d = d.withColumns({"rest": F.col("m") >= REST, "cut": F.col("__last").isNotNull(), "last": F.coalesce("__last", F.col("n") - 1)})
    d = d.withColumn("first", F.when(F.col("rest"), F.col("m") - 2).otherwise(F.lit(0))).where((F.col("last") - F.col("first") + 1 >= least) & F.col("k").between(F.col("first"), F.col("last")))
    d = written(d.select("name", "run", "k", "t", "first", "last", "rest", "cut", F.when(F.col("k") < F.col("last"), F.col("s")).alias("s")), "fall-steps")
    keys = ("name", "run")
    fast = medians(d, F.col("s"), keys).where(F.col("median") >= FAST).select(*keys)
    found = d.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.bool_or("rest").alias("rest_left_out"), F.bool_or("cut").alias("end_left_out"), F.sum("s").alias("travel")).join(fast, list(keys))
    return found.groupBy("name").agg(F.max_by(F.struct("first", "last", "rest_left_out", "end_left_out", "travel"), F.struct("travel", -F.col("first"))).alias("f")).select("name", "f.*")
