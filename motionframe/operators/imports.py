"""Imports of foreign tracks: names claimed landmark by landmark, cells written over, counters of what was left out.

A file's rows are (camera, ord, name, row, frame, x, y, confidence, visible, hand_placed, hidden); ``ord`` is a
name's place in the file, so that a name used twice stays two columns. Landmarks are (camera, name, fixed);
fixed ones (taken from a silhouette, a ball) are never placed from a file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions.scalars import formula_safe, in_frame, name_key, sanitize
from motionframe.operators.edits import CELL, DATA

CLAIM = "camera string, ord int, name string, target string, outcome string, repeated boolean"


def _claimed(wanted: pd.DataFrame, points: pd.DataFrame) -> list[tuple]:
    """One camera's names in file order, each with the landmark it fills: its own, a numbered copy of it, or a new one."""
    by_match, taken = dict(zip(points["match"], points["name"], strict=True)), set(points["key"])
    fixed, here, used, out = set(points["name"][points["fixed"]]), set(points["name"]), set(), []
    for w in wanted.sort_values("ord").itertuples():
        target = by_match.get(w.match)
        if target in fixed:
            out.append((w.ord, w.name, None, "skipped", False))
            continue
        repeated = target is not None and target in used
        if repeated or target is None:
            copies = [f"{w.safe} ({k})" for k in range(2, len(here) + 2)] if w.key in taken else []
            target = next((c for c in copies if c in here and c not in used | fixed), None)
        outcome = "updated" if target is not None else "new"
        if target is None:
            k = next(k for k in range(1, len(taken) + 2) if (w.key if k == 1 else f"{w.key} ({k})") not in taken)
            target = w.safe if k == 1 else f"{w.safe} ({k})"
            taken.add(w.key if k == 1 else f"{w.key} ({k})")
            here.add(target)
            by_match.setdefault(w.match, target)
        used.add(target)
        out.append((w.ord, w.name, target, outcome, repeated))
    return out


def claims(names: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(camera, ord, name, target, outcome, repeated) of a file's names (camera, ord, name).

    Both sides are a camera's names, a header's worth of rows, so a camera is one group. Names match as
    exporters write them, with case; a new name that is taken but for case gets a number.
    """
    keyed = lambda d, *more: d.select(F.col("camera").cast("string").alias("camera"), *more, "name", sanitize(formula_safe(F.col("name"))).alias("match"), formula_safe(F.col("name")).alias("safe"), name_key(formula_safe(F.col("name"))).alias("key"))

    def camera(key: tuple, wanted: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in _claimed(wanted, points)], columns=["camera", "ord", "name", "target", "outcome", "repeated"])

    left = keyed(names, F.col("ord").cast("int").alias("ord")).groupBy("camera")
    return left.cogroup(keyed(landmarks, F.coalesce("fixed", F.lit(False)).alias("fixed")).groupBy("camera")).applyInPandas(camera, CLAIM)


def placed(rows: DataFrame, width: int, height: int, frames: int, origin: float = 0.0, flip: bool = False) -> DataFrame:
    """A file's rows in picture coordinates, with ``fate``: kept, outside (the picture) or beyond (the video); rows without a position go."""
    x = F.col("x") - origin
    y = F.lit(height) - F.col("y") if flip else F.col("y") - origin
    d = rows.withColumns({"x": x, "y": y}).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    within = (F.col("frame") >= 0) & (F.col("frame") < frames)
    inside = in_frame(F.col("x"), F.col("y"), F.lit(width), F.lit(height))
    return d.withColumn("fate", F.when(~F.coalesce(within, F.lit(False)), "beyond").when(inside, "kept").otherwise("outside"))


def file_claims(rows: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Claims of the names that have a kept row in ``placed`` rows."""
    return claims(rows.where("fate = 'kept'").select("camera", "ord", "name").distinct(), landmarks)


def imported(cells: DataFrame, rows: DataFrame, claimed: DataFrame) -> DataFrame:
    """``cells`` with the kept ``rows`` written over them; where two rows reach one frame the later row of the file stays."""
    to = claimed.where("outcome <> 'skipped'").select("camera", "ord", F.col("target"))
    hit = rows.where("fate = 'kept'").join(to, ["camera", "ord"])
    fresh = hit.groupBy("camera", F.col("target").alias("name"), "frame").agg(F.max_by(F.struct(*DATA), "row").alias("d")).select(*CELL, "d.*")
    return cells.select(*CELL, *DATA).join(fresh.select(*CELL), list(CELL), "left_anti").unionByName(fresh)


def import_counts(rows: DataFrame, claimed: DataFrame) -> DataFrame:
    """(camera, cells, outside, beyond, new, updated, skipped, duplicates) of an import."""
    n = lambda c: F.count_if(c)
    d = rows.join(claimed.select("camera", "ord", "outcome"), ["camera", "ord"], "left")
    own = d.groupBy("camera").agg(n((F.col("fate") == "kept") & (F.col("outcome") != "skipped")).alias("cells"), *(n(F.col("fate") == f).alias(f) for f in ("outside", "beyond")))
    names = claimed.groupBy("camera").agg(*(n(F.col("outcome") == o).alias(o) for o in ("new", "updated", "skipped")), n(F.col("repeated")).alias("duplicates"))
    some: list[Column] = [F.coalesce(c, F.lit(0)).alias(c) for c in ("new", "updated", "skipped", "duplicates")]
    return own.join(names, "camera", "left").select("camera", "cells", "outside", "beyond", *some)
