"""Registered queries over body poses: the vectors as joints of a person, all fourteen angles, their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.operators import angles
from motionframe.plans.adapter import read
from motionframe.plans.motion import query

#: Joints in the order of their three components each.
JOINTS = [f"{side}_{part}" for part in ("shoulder", "elbow", "wrist", "hip", "knee", "ankle", "heel", "big_toe", "ear") for side in ("left", "right")]
#: Every so many rows a joint is unseen.
UNSEEN = 11


def _poses(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.col("label").alias("person"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    one = [F.struct(F.lit(j).alias("joint"), *(F.get("e", F.lit(3 * i + k)).alias(c) for k, c in enumerate("xyz")), F.when((F.col("frame") + i) % UNSEEN == 0, 0.1).otherwise(0.9).alias("conf")) for i, j in enumerate(JOINTS)]
    return e.select("person", "frame", F.inline(F.array(*one)))


def _angles(spark: SparkSession, sf: str) -> DataFrame:
    use = angles.applicable(set(JOINTS))
    return angles.long_angles(angles.joint_angles(angles.posed(_poses(spark, sf), JOINTS), use), use)


# The same in SQL, from vectors of three expressions.


def _joint(j: str) -> list[str]:
    return [f"j{JOINTS.index(j)}_{k}" for k in range(3)]


def _mid(js: tuple[str, ...]) -> list[str]:
    return _joint(js[0]) if len(js) == 1 else [f"(({a} + {b}) / 2)" for a, b in zip(_joint(js[0]), _joint(js[1]), strict=True)]


def _minus(u: list[str], v: list[str]) -> list[str]:
    return [f"({a} - {b})" for a, b in zip(u, v, strict=True)]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def _signed(u: list[str], v: list[str], axis: list[str]) -> str:
    c = [f"({u[i]} * {v[k]} - {u[k]} * {v[i]})" for i, k in ((1, 2), (2, 0), (0, 1))]
    return f"degrees(atan2({_dot(c, axis)}, {_dot(u, v)}))"


def _sql() -> str:
    at = lambda i, k: f"CASE WHEN (vec_id + {i}) % {UNSEEN} <> 0 THEN e[{3 * i + k + 1}] END AS j{i}_{k}"
    hips, shoulders = (_minus(_joint(f"left_{p}"), _joint(f"right_{p}")) for p in ("hip", "shoulder"))
    raw = [f"coalesce({a}, {b})" for a, b in zip(hips, shoulders, strict=True)]
    parts, axis = [], ["a0", "a1", "a2"]
    for a in angles.ANGLES:
        p = [_mid(x) for x in a.points]
        if a.kind == "joint":
            u, v = _minus(p[0], p[1]), _minus(p[2], p[1])
            value = f"degrees(acos(greatest(least({_dot(u, v)} / (sqrt({_dot(u, u)}) * sqrt({_dot(v, v)})), 1), -1)))"
        elif a.kind == "sagittal":
            value = _signed(_minus(p[0], p[1]), _minus(p[2], p[1]), axis)
        elif a.kind == "segments":
            value = _signed(_minus(p[1], p[0]), _minus(p[3], p[2]), axis)
        elif a.kind == "lean":
            value = _signed(["m0", "m1", "m2"], _minus(p[1], p[0]), axis)
        else:
            s, h = _minus(p[1], p[0]), _minus(p[3], p[2])
            flat = lambda u: [f"({x} - {_dot(u, ['t0', 't1', 't2'])} * {t})" for x, t in zip(u, ["t0", "t1", "t2"], strict=True)]  # noqa: E731, B023
            value = _signed(flat(h), flat(s), ["t0", "t1", "t2"])
        lo, hi = a.window
        v = f"({a.scale} * {value} + {a.offset})"
        fold = "v" if a.kind == "joint" else f"CASE WHEN v > {lo} AND v <= {hi} THEN v ELSE {hi} - (({hi} - v) - 360 * floor(({hi} - v) / 360)) END"
        parts.append(f"SELECT person, frame, '{a.name}' AS angle, {fold} AS degrees FROM (SELECT person, frame, {v} AS v FROM axes)")
    trunk = _minus(_mid(("left_shoulder", "right_shoulder")), _mid(("left_hip", "right_hip")))
    norm = lambda u: f"sqrt({_dot(u, u)})"
    return f"""WITH j AS (SELECT label AS person, vec_id AS frame, {", ".join(at(i, k) for i in range(len(JOINTS)) for k in range(3))} FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
        u AS (SELECT *, {", ".join(f"{x} AS r{k}" for k, x in enumerate(raw))}, {", ".join(f"{x} / {norm(trunk)} AS t{k}" for k, x in enumerate(trunk))} FROM j),
        axes AS (SELECT *, {", ".join(f"r{k} / sqrt(r0*r0 + r1*r1 + r2*r2) AS a{k}, median(t{k}) OVER (PARTITION BY person) AS m{k}" for k in range(3))} FROM u),
        ang AS ({" UNION ALL ".join(parts)})"""


@query(_sql() + " SELECT person, frame, angle, round(degrees, 4) AS degrees FROM ang WHERE degrees IS NOT NULL")
def joint_angles(spark, sf):
    """All fourteen angles of every pose."""
    return _angles(spark, sf).where("degrees is not null").select("person", "frame", "angle", F.round("degrees", 4).alias("degrees"))


@query(_sql() + """, n AS (SELECT label AS person, count(*) AS posed, avg(0.5 + vec_id % 5 / 20.0) AS score FROM embeddings GROUP BY label), c AS (SELECT count(DISTINCT frame) * 1.0 / (SELECT count(*) FROM embeddings) AS cover FROM ang WHERE degrees IS NOT NULL)
    SELECT person, posed, round(score, 6) AS score, score < 0.6 AS doubtful, round(cover, 6) AS cover, CASE WHEN cover >= 0.9 THEN 'good' WHEN cover >= 0.5 THEN 'ok' ELSE 'poor' END AS verdict, angle, round(min(degrees), 4) AS lo, round(max(degrees), 4) AS hi, round(max(degrees) - min(degrees), 4) AS span, round(median(degrees), 4) AS median
    FROM ang JOIN n USING (person), c WHERE degrees IS NOT NULL GROUP BY ALL""")
def angle_report(spark, sf):
    e = read(spark, sf, "embeddings")
    scores = e.groupBy(F.col("label").alias("person")).agg(F.count("*").alias("posed"), F.avg(0.5 + F.col("vec_id") % 5 / 20.0).alias("score"))
    d = angles.angle_report(_angles(spark, sf), scores, e.count())
    return d.select("person", "posed", F.round("score", 6).alias("score"), "doubtful", F.round("cover", 6).alias("cover"), "verdict", "angle", *(F.round(c, 4).alias(c) for c in ("lo", "hi", "span", "median")))
