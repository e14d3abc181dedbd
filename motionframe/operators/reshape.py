"""Long and wide forms: pivots with an explicit column list, unpivots, ranked instances, exports' layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import one_based_xy

#: Wide forms have a column for each name, so names are a small dimension; more are refused.
MOST_NAMES = 5000


def names_in_order(cells: DataFrame) -> list[str]:
    """Distinct landmark names by their first camera and text: the column list of wide forms."""
    rows = cells.groupBy("name").agg(F.min("camera").alias("c")).orderBy("c", "name").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a wide form would have more than {MOST_NAMES} landmarks")
    return [r["name"] for r in rows]


def wide(cells: DataFrame, names: list[str], values: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ("camera", "frame")) -> DataFrame:
    """One row for each key with ``<name>_<value>`` columns; conditional aggregates, so one shuffle and no second pass for the names."""
    aggs = [F.max(F.when(F.col("name") == n, F.col(v))).alias(f"{n}_{v}") for n in names for v in values]
    return cells.where(F.col("name").isin(names)).groupBy(*keys).agg(*aggs)


def long(table: DataFrame, names: list[str], values: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = ("camera", "frame")) -> DataFrame:
    """Inverse of ``wide``; cells without any value are left out. One pass, no shuffle."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), *(F.col(f"`{n}_{v}`").alias(v) for v in values)) for n in names))
    out = table.select(*keys, F.inline(rows))
    return out.where(" or ".join(f"{v} is not null" for v in values))


def on_spine(table: DataFrame, frames: int, camera: str) -> DataFrame:
    """One camera's wide rows on a complete frame spine."""
    spine = table.sparkSession.range(frames).select(F.col("id").alias("frame"))
    return spine.join(table.where(F.col("camera") == camera).drop("camera"), "frame", "left")


def best_instances(rows: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Of several instances in a frame those hand-labelled (no score) before all others, then the best score; equals all stay."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").isNull().desc(), F.col("score").desc())
    return rows.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def one_based(cells: DataFrame, height: int, flip: bool = True) -> DataFrame:
    """(camera, point, frame, x, y) in the layout that counts from 1."""
    x, y = one_based_xy(F.col("x"), F.col("y"), F.lit(height), flip)
    return cells.where(~F.col("hidden")).select("camera", "name", (F.col("frame") + 1).alias("frame"), x.alias("x"), y.alias("y"))


def instance_scores(cells: DataFrame, animal: str = "camera") -> DataFrame:
    """(animal, frame, n, score): one row where at least one point is exported, with the mean confidence."""
    return cells.where(~F.col("hidden")).groupBy(animal, "frame").agg(F.count("*").alias("n"), F.avg("confidence").alias("score"))


def best_views(views: DataFrame, keep: int, width: float, height: float, keys: tuple[str, ...] = ("camera",)) -> DataFrame:
    """The ``keep`` best views (n, sx, sy) of each key by point count and spread, in frame order."""
    quality = F.col("n") + 10 * (F.coalesce(F.col("sx") / width, F.lit(0.0)) + F.coalesce(F.col("sy") / height, F.lit(0.0))) / 2
    d = views.withColumn("quality", quality)
    w = Window.partitionBy(*keys).orderBy(F.desc("quality"), "frame")
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")
