"""Joint angles from poses in long form (frame, person, joint, x, y, z): one pivot, then expressions.

An angle is ``scale * raw + offset``, folded into its window. Signed ones are taken about the subject's
left-right axis, so a limb that swings forwards is positive on both sides of the body.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions import scalars as S
from motionframe.operators.quantiles import medians
from motionframe.sources.scratch import written

SEEN = 0.15


@dataclass(frozen=True)
class Angle:
    """``kind`` and the points it takes; a point with two joints is their middle."""

    name: str
    kind: str
    points: tuple[tuple[str, ...], ...]
    scale: float
    offset: float
    window: tuple[float, float] = (-180.0, 180.0)


def _paired(name: str, kind: str, parts: tuple[str, ...], scale: float, offset: float, window: tuple[float, float] = (-180.0, 180.0)) -> list[Angle]:
    return [Angle(f"{side} {name}", kind, tuple((f"{side}_{p}",) for p in parts), scale, offset, window) for side in ("left", "right")]


def _middle(part: str) -> tuple[str, str]:
    return f"left_{part}", f"right_{part}"


# The fourteen angles with their zero positions and windows.
ANGLES = (
    *_paired("elbow flexion", "joint", ("shoulder", "elbow", "wrist"), -1.0, 180.0),
    *_paired("shoulder flexion", "sagittal", ("hip", "shoulder", "elbow"), -1.0, 0.0, (-90.0, 270.0)),
    *_paired("knee flexion", "joint", ("hip", "knee", "ankle"), -1.0, 180.0),
    *_paired("hip flexion", "sagittal", ("shoulder", "hip", "knee"), -1.0, 180.0),
    *_paired("ankle dorsiflexion", "segments", ("ankle", "knee", "heel", "big_toe"), -1.0, 90.0),
    Angle("neck flexion", "sagittal", (_middle("ear"), _middle("shoulder"), _middle("hip")), -1.0, 180.0),
    Angle("trunk lean", "lean", (_middle("hip"), _middle("shoulder")), 1.0, 0.0),
    Angle("thigh separation (stride)", "segments", (("left_hip",), ("left_knee",), ("right_hip",), ("right_knee",)), 1.0, 0.0),
    Angle("shoulder-hip twist", "twist", (("right_shoulder",), ("left_shoulder",), ("right_hip",), ("left_hip",)), 1.0, 0.0),
)


def applicable(joints: set[str], angles: tuple[Angle, ...] = ANGLES) -> list[Angle]:
    """The angles whose joints a rig has."""
    return [a for a in angles if all(j in joints for p in a.points for j in p)]


def posed(poses: DataFrame, joints: list[str], keys: tuple[str, ...] = ("person", "frame")) -> DataFrame:
    """One row for each key with a struct column for each joint; joints scored under 0.15 are unseen, unscored ones never."""
    seen = F.coalesce(F.col("conf") >= SEEN, F.lit(True))
    return poses.where(F.col("joint").isin(joints)).groupBy(*keys).agg(*(F.max(F.when((F.col("joint") == j) & seen, F.struct("x", "y", "z"))).alias(j) for j in joints))


def _point(joints: tuple[str, ...]) -> list[Column]:
    return [sum((F.col(f"`{j}`.{c}") for j in joints[1:]), F.col(f"`{joints[0]}`.{c}")) / len(joints) for c in "xyz"]


def lateral_axis() -> list[Column]:
    """The subject's left, from the hips or else the shoulders."""
    hips, shoulders = (S.minus(_point((f"left_{p}",)), _point((f"right_{p}",))) for p in ("hip", "shoulder"))
    raw = [F.coalesce(a, b) for a, b in zip(hips, shoulders, strict=True)]
    return [F.try_divide(c, S.norm(raw)) for c in raw]


def joint_angles(wide: DataFrame, angles: list[Angle], person: tuple[str, ...] = ("person",)) -> DataFrame:
    """Adds a column for each angle, in degrees, NULL where a joint is missing.

    The trunk leans against its usual direction: the medians of a person's unit vectors, component by component.
    """
    axis = lateral_axis()
    columns = wide.columns
    wide = written(wide, "poses")
    for lean in [a for a in angles if a.kind == "lean"][:1]:
        low, high = (_point(x) for x in lean.points)
        trunk = S.minus(high, low)
        units = wide.select(*person, *(F.try_divide(c, S.norm(trunk)).alias(f"__{k}") for k, c in zip("xyz", trunk, strict=True)))
        for k in "xyz":
            usual = medians(units, F.col(f"__{k}"), person, f"__usual_{k}").select(*(F.col(q).alias(f"__p{i}") for i, q in enumerate(person)), f"__usual_{k}")
            wide = wide.join(usual, [F.col(q).eqNullSafe(F.col(f"__p{i}")) for i, q in enumerate(person)], "left").drop(*(f"__p{i}" for i in range(len(person))))

    def into(window: tuple[float, float]):
        return lambda v: S.fold(v, *window)

    def measured(axis: list[Column]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for a in angles:
            p = [_point(x) for x in a.points]
            if a.kind == "joint":
                raw = S.interior_angle(*p)
            elif a.kind == "sagittal":
                raw = S.signed_angle(S.minus(p[0], p[1]), S.minus(p[2], p[1]), axis)
            elif a.kind == "segments":
                raw = S.signed_angle(S.minus(p[1], p[0]), S.minus(p[3], p[2]), axis)
            elif a.kind == "lean":
                raw = S.signed_angle([F.col(f"__usual_{c}") for c in "xyz"], S.minus(p[1], p[0]), axis)
            else:
                middle = lambda x, y: [(i + j) / 2 for i, j in zip(x, y, strict=True)]
                raw = S.twist(S.minus(p[1], p[0]), S.minus(p[3], p[2]), S.minus(middle(p[0], p[1]), middle(p[2], p[3])))
            value = a.scale * raw + a.offset
            out[a.name] = value if a.kind == "joint" else S.let(value, into(a.window))
        return out

    # The axis is bound once, for most angles use it.
    bound = F.struct(*(c.alias(k) for k, c in zip("xyz", axis, strict=True)))
    all_of_them = S.let(bound, lambda a: F.struct(*(v.alias(n) for n, v in measured([a[k] for k in "xyz"]).items())))
    d = wide.withColumn("__angles", all_of_them)
    return d.select(*columns, *(F.col("__angles")[a.name].alias(a.name) for a in angles))


def long_angles(wide: DataFrame, angles: list[Angle], keys: tuple[str, ...] = ("person", "frame")) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(a.name).alias("angle"), F.col(f"`{a.name}`").alias("degrees")) for a in angles))
    return wide.select(*keys, F.inline(rows))


def range_of_motion(angles: DataFrame, keys: tuple[str, ...] = ("person",)) -> DataFrame:
    """(keys, angle, lo, hi, span, median) of the degrees that aren't NULL."""
    by = (*keys, "angle")
    ends = angles.groupBy(*by).agg(F.min("degrees").alias("lo"), F.max("degrees").alias("hi"), (F.max("degrees") - F.min("degrees")).alias("span"))
    middle = medians(angles, F.col("degrees"), by)
    same = [ends[k].eqNullSafe(middle[k]) for k in by]
    return ends.join(middle, same, "left").select(*(ends[k] for k in by), "lo", "hi", "span", "median")


#: Shares of frames with a person from which a report is good or ok, and the score under which a person is doubtful.
GOOD_COVER, OK_COVER, DOUBTFUL = 0.9, 0.5, 0.6


def angle_report(angles: DataFrame, scores: DataFrame, frames: int, keys: tuple[str, ...] = ("person",)) -> DataFrame:
    """(keys, posed, score, doubtful, cover, verdict, angle, lo, hi, span, median): a row for each person and angle that has values.

    ``angles`` is long (keys, frame, angle, degrees), ``scores`` has the mean detector score and the number of
    posed frames of each person. The verdict is of all: on how many of ``frames`` anybody was found.
    """
    angles = written(angles.where("degrees is not null"), "angles")
    found = angles.agg(F.count_distinct("frame")).scalar()
    cover = found / F.lit(float(frames)) if frames else F.lit(0.0)
    verdict = F.when(cover >= GOOD_COVER, "good").when(cover >= OK_COVER, "ok").when(found > 0, "poor").otherwise("nothing found")
    d = range_of_motion(angles, keys).where("span is not null").join(scores, list(keys), "left")
    return d.select(*keys, "posed", "score", (F.col("score") < DOUBTFUL).alias("doubtful"), cover.alias("cover"), verdict.alias("verdict"), "angle", "lo", "hi", "span", "median")
