"""Cell-level edits with precedence rules; each takes a cell table and returns the edited one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("camera", "name", "frame")
DATA = ("x", "y", "confidence", "visible", "hand_placed", "hidden")


def _range(lo: int | None, hi: int | None) -> Column:
    c = F.col("frame")
    return (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c <= hi)


def upserted(cells: DataFrame, fresh: DataFrame, width: int, height: int, keep_hand: bool = True) -> DataFrame:
    """A tracker's window written over ``cells``: hand-placed cells stay, predictions off the picture become blank."""
    from motionframe.functions.scalars import in_frame

    inside = in_frame(F.col("x"), F.col("y"), F.lit(width), F.lit(height))
    new = fresh.select(*CELL, *(F.when(inside, F.col(c)).alias(f"n_{c}") for c in ("x", "y")), F.when(inside, F.col("confidence")).otherwise(0.0).alias("n_confidence"), F.lit(True).alias("n"))
    d = cells.join(new, list(CELL), "full")
    mine = F.col("n").isNull() | (F.coalesce("hand_placed", F.lit(False)) if keep_hand else F.lit(False))
    pick = lambda c: F.when(mine, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
    rest = [F.coalesce("visible", F.lit(True)).alias("visible"), (F.coalesce("hand_placed", F.lit(False)) & mine).alias("hand_placed"), F.coalesce("hidden", F.lit(False)).alias("hidden")]
    return d.select(*CELL, pick("x"), pick("y"), pick("confidence"), *rest)


def cleared(cells: DataFrame, names: list[str], lo: int, hi: int, keep_hand: bool = True) -> DataFrame:
    gone = F.col("name").isin(names) & _range(lo, hi)
    return cells.where(~gone | F.col("hand_placed") if keep_hand else ~gone)


def swapped(cells: DataFrame, a: str, b: str, lo: int, hi: int) -> DataFrame:
    name = F.when(_range(lo, hi) & (F.col("name") == a), b).when(_range(lo, hi) & (F.col("name") == b), a).otherwise(F.col("name"))
    return cells.withColumn("name", name)


def moved(cells: DataFrame, src: str, dst: str, lo: int, hi: int) -> DataFrame:
    """``dst`` takes ``src``'s cells of a range, over its own; ``src`` is cleared there."""
    taken = cells.where((F.col("name") == src) & _range(lo, hi)).withColumn("name", F.lit(dst))
    rest = cells.where(~((F.col("name") == src) & _range(lo, hi)))
    return rest.join(taken.select(*CELL), list(CELL), "left_anti").unionByName(taken)


def gaps_filled(cells: DataFrame, src: str, dst: str, lo: int, hi: int) -> DataFrame:
    """``dst`` takes ``src``'s cells only where it has none."""
    offered = cells.where((F.col("name") == src) & _range(lo, hi)).withColumn("name", F.lit(dst))
    return cells.unionByName(offered.join(cells.where(F.col("name") == dst).select(*CELL), list(CELL), "left_anti"))


def split(cells: DataFrame, name: str, frame: int, fresh: str) -> DataFrame:
    return cells.withColumn("name", F.when((F.col("name") == name) & (F.col("frame") >= frame), fresh).otherwise(F.col("name")))


def placed(cells: DataFrame, camera: str, name: str, frame: int, x: float, y: float) -> DataFrame:
    """One hand-placed cell, fully trusted, over whatever was there."""
    here = (F.col("camera") == camera) & (F.col("name") == name) & (F.col("frame") == frame)
    values = {"camera": camera, "name": name, "frame": frame, "x": x, "y": y, "confidence": 1.0, "visible": True, "hand_placed": True, "hidden": False}
    one = cells.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in cells.schema))
    return cells.where(~here).unionByName(one)


def hidden(cells: DataFrame, names: list[str], lo: int, hi: int, on: bool = True) -> DataFrame:
    return cells.withColumn("hidden", F.when(F.col("name").isin(names) & _range(lo, hi), on).otherwise(F.col("hidden")))


def restored(cells: DataFrame, snapshot: DataFrame, names: list[str], lo: int, hi: int) -> DataFrame:
    """The cells of a range put back from a snapshot."""
    part = F.col("name").isin(names) & _range(lo, hi)
    return cells.where(~part).unionByName(snapshot.where(part))


def removed(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.where(~F.col("name").isin(names))


def renamed(cells: DataFrame, old: str, desired: str) -> DataFrame:
    """A landmark's new name, with a number after it if the name is taken anywhere."""
    taken = cells.where(F.col("name") != old).select("name").distinct()
    suffix = F.expr(f"try_cast(regexp_extract(name, '^\\\\Q{desired}\\\\E \\\\((\\\\d+)\\\\)$', 1) as int)")
    busy = taken.agg(F.bool_or(F.col("name") == desired).alias("clash"), F.max(F.coalesce(suffix, F.lit(1))).alias("k"))
    to = F.when(F.col("clash"), F.concat(F.lit(desired), F.lit(" ("), F.col("k") + 1, F.lit(")"))).otherwise(desired)
    return cells.crossJoin(F.broadcast(busy)).withColumn("name", F.when(F.col("name") == old, to).otherwise(F.col("name"))).drop("clash", "k")  # one row


def events_clamped(events: DataFrame, frames: int) -> DataFrame:
    """Named frame windows with reversed ends swapped and clamped to the recording."""
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(frames - 1))
    return events.withColumns({"start": inside(F.least("start", "end")), "end": inside(F.greatest("start", "end"))})


def rebased(cameras: DataFrame) -> DataFrame:
    """Clocks with the first camera as the reference, at offset 0 and rate 1: rates are divided by its rate, offsets lose their new rate times its offset."""
    first = cameras.agg(F.min_by(F.struct("offset", "rate"), "ord").alias("__first"))
    d = cameras.crossJoin(F.broadcast(first)).withColumn("rate", F.col("rate") / F.col("__first.rate"))  # one row
    return d.withColumn("offset", F.col("offset") - F.col("rate") * F.col("__first.offset")).drop("__first")


def last_write_wins(windows: DataFrame, version: str = "window") -> DataFrame:
    """Overlapping windows compacted: the latest version of each cell."""
    values = [c for c in windows.columns if c not in (*CELL, version)]
    best = F.max_by(F.struct(*values), version).alias("v")
    return windows.groupBy(*CELL).agg(best).select(*CELL, "v.*")


def pose_runs_merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("frame", "person")) -> DataFrame:
    """Poses of a new run over an old one, the old kept where the new found nobody."""
    values = [c for c in old.columns if c not in keys]
    d = old.join(new.select(*keys, *(F.col(c).alias(f"n_{c}") for c in values), F.lit(True).alias("__new")), list(keys), "full")
    return d.select(*keys, *(F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in values))
