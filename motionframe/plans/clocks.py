"""Registered queries over clocks and timing: tracks of smoothly moving points, seen by cameras whose clocks are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import dlt_project
from motionframe.operators import clock_search, falls, timing
from motionframe.operators.alignment import sampled
from motionframe.plans.adapter import DLT, DLT_SQL, read, with_
from motionframe.plans.motion import _SUMS, query

#: Frames from one known point of a path to the next, and the true clocks of the four cameras: (rate, offset).
STEP = 16
TRUE = ((1.0, 0.0), (1.0, 3.30), (2.0, -2.60), (1.0, 1.15))
#: What the search starts from: whole frames.
GIVEN = (0.0, 3.0, -3.0, 1.0)


def moving_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """(camera, name, frame, x, y): a point of each label goes from one vector's first three components to the next one's.

    A camera films it by its true clock and misses every 23rd frame.
    """
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    order = Window.partitionBy("label").orderBy("vec_id")
    here = F.struct(*(at(i).alias(c) for i, c in enumerate("xyz")))
    k = read(spark, sf, "embeddings").select(F.concat(F.lit("e"), "label").alias("name"), (F.row_number().over(order) - 1).alias("k"), here.alias("a"), F.lead(here).over(order).alias("b")).where("b is not null")
    views = []
    for c, (rate, offset) in enumerate(TRUE):
        lo, hi = rate * STEP * F.col("k") + offset, rate * STEP * (F.col("k") + 1) + offset
        d = k.withColumn("frame", F.explode(F.sequence(F.ceil(lo), F.ceil(hi) - 1))).where(F.pmod(F.col("frame") + 5 * c, F.lit(23)) != 0)
        w = ((F.col("frame") - offset) / rate - STEP * F.col("k")) / STEP
        w = w * w * (3 - 2 * w)
        p = [F.col(f"a.{x}") + w * (F.col(f"b.{x}") - F.col(f"a.{x}")) for x in "xyz"]
        u, v = dlt_project([F.lit(x) for x in DLT[c]], *p)
        views.append(d.select(F.lit(f"c{c}").alias("camera"), "name", "frame", u.alias("x"), v.alias("y")))
    return views[0].union(views[1]).union(views[2]).union(views[3])


def _view(c: int) -> str:
    rate, offset = TRUE[c]
    n = DLT[c]
    p = [f"(a{i} + w * (b{i} - a{i}))" for i in range(3)]
    line = lambda o: f"({n[o]}::DOUBLE * {p[0]} + {n[o + 1]}::DOUBLE * {p[1]} + {n[o + 2]}::DOUBLE * {p[2]} + {n[o + 3] if o < 8 else 1}::DOUBLE)"
    return f"""SELECT {c} AS cam, name, frame, {line(0)} / {line(8)} AS x, {line(4)} / {line(8)} AS y FROM (SELECT *, s * s * (3 - 2 * s) AS w FROM (SELECT *, ((frame - {offset}::DOUBLE) / {rate}::DOUBLE - {STEP} * k) / {STEP} AS s FROM
        (SELECT *, unnest(range(CAST(ceil({rate}::DOUBLE * {STEP} * k + {offset}::DOUBLE) AS BIGINT), CAST(ceil({rate}::DOUBLE * {STEP} * (k + 1) + {offset}::DOUBLE) AS BIGINT))) AS frame FROM knots) WHERE (frame + {5 * c} + 2300) % 23 <> 0))"""


MOVING = f"""knots AS (SELECT * FROM (SELECT 'e' || label AS name, row_number() OVER w - 1 AS k, {", ".join(f"embedding[{i + 1}]::DOUBLE AS a{i}, lead(embedding[{i + 1}]::DOUBLE) OVER w AS b{i}" for i in range(3))}
    FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE b0 IS NOT NULL), moving AS ({" UNION ALL ".join(_view(c) for c in range(4))})"""


def given_rig(spark: SparkSession) -> clock_search.Rig:
    cameras = spark.createDataFrame([(f"c{c}", c, off, rate) for c, ((rate, _), off) in enumerate(zip(TRUE, GIVEN, strict=True))], "camera string, ord int, offset double, rate double")
    return clock_search.rig(cameras, {f"c{c}": coefs for c, coefs in enumerate(DLT)})


@query("SELECT * FROM (VALUES " + ", ".join(f"('c{c}', {o}::DOUBLE)" for c, (_, o) in enumerate(TRUE)) + ') t(camera, "offset")')
def clock_search_finds(spark, sf):
    """The offsets found from the tracks, to a hundredth of a frame; the oracle is the truth that the tracks were made with."""
    found = clock_search.estimated_offsets(moving_tracks(spark, sf), given_rig(spark))
    return found.select("camera", F.round("offset", 2).alias("offset"))


#: Candidates of one round: the second camera half-frame by half-frame.
_TRIED = [-1.0, -0.5, 0.0, 0.5, 1.0]
_RIG_SQL = "rig(cam, rate, off, width) AS (VALUES " + ", ".join(f"({c}, {r}::DOUBLE, {o}::DOUBLE, {max(1.0, r)}::DOUBLE)" for c, ((r, _), o) in enumerate(zip(TRUE, GIVEN, strict=True))) + ")"
_PROBES = """probe AS (SELECT cam, rate, off, unnest(CASE WHEN cam = 0 THEN [0.0::DOUBLE] WHEN width < 2 THEN [-width, 0.0::DOUBLE, width] ELSE [-width, -width / 2, 0.0::DOUBLE, width / 2, width] END) AS d FROM rig),
    want AS (SELECT DISTINCT name, unnest(range(tmin, tmax + 1)) AS t FROM (SELECT name, CAST(floor(min((frame - off) / rate)) AS BIGINT) - 5 AS tmin, CAST(ceil(max((frame - off) / rate)) AS BIGINT) + 5 AS tmax FROM moving JOIN rig USING (cam) GROUP BY name)),
    sample AS (SELECT DISTINCT p.name, t, p.cam, d, CASE WHEN abs(f - round(f)) < 1e-9 THEN n.x ELSE l.x * (1 - (f - floor(f))) + h.x * (f - floor(f)) END AS u, CASE WHEN abs(f - round(f)) < 1e-9 THEN n.y ELSE l.y * (1 - (f - floor(f))) + h.y * (f - floor(f)) END AS v
        FROM (SELECT name, t, cam, d, rate * t + off + d AS f FROM want, (SELECT * FROM probe UNION SELECT cam, rate, off, unnest({tried}) FROM rig WHERE cam = 1)) p
        LEFT JOIN moving n ON n.cam = p.cam AND n.name = p.name AND n.frame = round(f) LEFT JOIN moving l ON l.cam = p.cam AND l.name = p.name AND l.frame = floor(f) LEFT JOIN moving h ON h.cam = p.cam AND h.name = p.name AND h.frame = floor(f) + 1),
    stable AS (SELECT name, t, s.cam FROM sample s JOIN probe p ON p.cam = s.cam AND p.d = s.d GROUP BY name, t, s.cam HAVING bool_and(u IS NOT NULL)),
    scored AS (SELECT *, count(*) OVER (PARTITION BY name, t) AS seen FROM stable QUALIFY seen >= 2),
    observed AS (SELECT c.d || '/' || s.name AS name, s.t AS frame, s.cam, u, v FROM scored s JOIN (SELECT unnest({tried}) AS d) c ON true JOIN sample x ON x.name = s.name AND x.t = s.t AND x.cam = s.cam AND x.d = CASE WHEN s.cam = 1 THEN c.d ELSE 0 END)"""


@query(with_(MOVING, _RIG_SQL, _PROBES.replace("{tried}", "[" + ", ".join(f"{d}::DOUBLE" for d in _TRIED) + "]"), DLT_SQL, _SUMS) + "SELECT split_part(name, '/', 1)::DOUBLE AS shift, count(*) AS n, round(avg(residual), 6) AS cost FROM point GROUP BY 1")
def clock_search_round(spark, sf):
    """The scores of one round of candidates: shifts of the second camera."""
    r = given_rig(spark)
    table = clock_search.written(clock_search.windows(moving_tracks(spark, sf), r), "clock-windows")
    found = clock_search.costs(table, r, [[o + d if c == 1 else o for c, o in enumerate(r.offsets)] for d in _TRIED])
    scored = clock_search._own_cells(table, r)[-1]
    return spark.createDataFrame([(d, scored, f) for d, f in zip(_TRIED, found, strict=True)], "shift double, n long, cost double").select("shift", "n", F.round("cost", 6).alias("cost"))


# ---- timing of pairs -----------------------------------------------------------------------------------------

#: Clocks that are right but for the second camera, which is three frames off.
OFF_BY_THREE = (0.0, 0.30, -2.60, 1.15)


def _timed_cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"c{c}", c, off, rate) for c, ((rate, _), off) in enumerate(zip(TRUE, OFF_BY_THREE, strict=True))], "camera string, ord int, offset double, rate double")


@query("SELECT * FROM (VALUES ('c0', 0), ('c1', 3), ('c2', 0), ('c3', 0)) t(camera, suggested)")
def timing_check_finds(spark, sf):
    """The shift of each camera that the pairs agree on; the oracle is the truth that the tracks were made with."""
    return timing.timing_check(moving_tracks(spark, sf), _timed_cameras(spark), ("e1", "e2")).select("camera", "suggested")


_LATE_SQL = "late(cam, rate, off) AS (VALUES " + ", ".join(f"({c}, {r}::DOUBLE, {o}::DOUBLE)" for c, ((r, _), o) in enumerate(zip(TRUE, OFF_BY_THREE, strict=True))) + ")"


@query(with_(MOVING, _LATE_SQL) + """, s AS (SELECT cam, unnest([-3, 0, 3]) AS shift, rate, off FROM late), t AS (SELECT unnest(range(CAST(min(frame) / 2 AS BIGINT) - 10, max(frame) + 11)) AS t FROM moving),
    f AS (SELECT cam, shift, t, rate * t + off + shift AS f FROM s, t), w AS (SELECT f.cam, shift, t, name FROM f JOIN moving m ON m.cam = f.cam AND name IN ('e1', 'e2') AND m.frame = CASE WHEN abs(f - round(f)) < 1e-9 THEN round(f) ELSE floor(f) END
        WHERE abs(f - round(f)) < 1e-9 OR EXISTS (SELECT 1 FROM moving h WHERE h.cam = m.cam AND h.name = m.name AND h.frame = floor(f) + 1)),
    both_ AS (SELECT cam, shift, t FROM w GROUP BY ALL HAVING count(DISTINCT name) = 2)
    SELECT 'c' || a.cam AS a, 'c' || b.cam AS b, b.shift, count(*) AS n FROM both_ a JOIN both_ b ON a.t = b.t AND a.cam < b.cam AND a.shift = 0 GROUP BY ALL""")
def timing_rows(spark, sf):
    """How many instants each pair shares at three shifts."""
    c = _timed_cameras(spark)
    left, right = (c.select(F.col("camera").alias(x), F.col("ord").alias(f"o{x}")) for x in "ab")
    shifts = left.crossJoin(right).where("oa < ob").select("a", "b", F.explode(F.array(F.lit(-3), F.lit(0), F.lit(3))).alias("shift"))
    return timing.shared_views(moving_tracks(spark, sf), c, ("e1", "e2"), shifts).groupBy("a", "b", "shift").agg(F.count("*").alias("n"))


# ---- falls ---------------------------------------------------------------------------------------------------

_FALL_SQL = """late(cam, rate, off) AS (VALUES """ + ", ".join(f"({c}, {r}::DOUBLE, {o}::DOUBLE)" for c, (r, o) in enumerate(TRUE)) + """),
    at_ AS (SELECT DISTINCT cam, name, unnest(range(CAST(floor((frame - 1 - off) / rate) AS BIGINT), CAST(ceil((frame + 1 - off) / rate) AS BIGINT) + 1)) AS t, rate, off FROM moving JOIN late USING (cam)),
    want AS (SELECT DISTINCT cam, name, t, rate * t + off AS f FROM at_),
    smp AS (SELECT w.cam, w.name, t, CASE WHEN whole THEN n.x ELSE l.x * (1 - (f - floor(f))) + h.x * (f - floor(f)) END AS x, CASE WHEN whole THEN n.y ELSE l.y * (1 - (f - floor(f))) + h.y * (f - floor(f)) END AS y
        FROM (SELECT *, abs(f - floor(f + 0.5)) < 1e-9 AS whole FROM want) w LEFT JOIN moving n ON n.cam = w.cam AND n.name = w.name AND n.frame = floor(f + 0.5) LEFT JOIN moving l ON l.cam = w.cam AND l.name = w.name AND l.frame = floor(f) LEFT JOIN moving h ON h.cam = w.cam AND h.name = w.name AND h.frame = floor(f) + 1),
    got AS (SELECT * FROM smp WHERE x IS NOT NULL), ok AS (SELECT name, t FROM got GROUP BY name, t HAVING count(*) >= 2),
    run AS (SELECT name, t, t - row_number() OVER (PARTITION BY name ORDER BY t) AS run FROM ok), own AS (SELECT got.*, run FROM got JOIN run USING (name, t)),
    vel AS (SELECT a.name, a.run, a.t, a.cam, b.x - a.x AS vx, b.y - a.y AS vy FROM own a JOIN own b ON b.cam = a.cam AND b.name = a.name AND b.run = a.run AND b.t = a.t + 1),
    spd AS (SELECT name, run, t, median(sqrt(vx*vx + vy*vy) / 1.024) AS s FROM vel GROUP BY ALL),
    trn AS (SELECT a.name, a.run, a.t, median((a.vx*b.vx + a.vy*b.vy) / nullif(sqrt(a.vx*a.vx + a.vy*a.vy) * sqrt(b.vx*b.vx + b.vy*b.vy), 0)) AS turn FROM vel a JOIN vel b ON b.cam = a.cam AND b.name = a.name AND b.run = a.run AND b.t = a.t + 1 GROUP BY ALL),
    stp AS (SELECT run.*, s, turn, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY name, run.run) AS n FROM run LEFT JOIN spd USING (name, run, t) LEFT JOIN trn USING (name, run, t) WINDOW w AS (PARTITION BY name, run.run ORDER BY t)),
    rel AS (SELECT name, run, min(k) AS m FROM (SELECT *, lead(s) OVER w AS s1, lead(s, 2) OVER w AS s2 FROM stp WINDOW w AS (PARTITION BY name, run ORDER BY t)) WHERE s >= 1 AND s1 >= 1 AND s2 >= 1 GROUP BY name, run),
    ends AS (SELECT p.*, m, lag(s) OVER w AS s0, lag(turn) OVER w AS c0 FROM stp p JOIN rel USING (name, run) WINDOW w AS (PARTITION BY name, run ORDER BY t)),
    cut AS (SELECT name, run, min(k) AS e FROM ends WHERE k > m AND k < n - 1 AND (s IS NULL OR (s0 >= 2 AND (s < 1 OR s < 0.5 * s0 OR c0 < 0))) GROUP BY name, run),
    fall AS (SELECT p.*, m >= 4 AS rest, e IS NOT NULL AS cut, CASE WHEN m >= 4 THEN m - 2 ELSE 0 END AS a, coalesce(e, n - 1) AS b FROM ends p LEFT JOIN cut USING (name, run)),
    sums AS (SELECT name, min(t) AS "first", max(t) AS "last", bool_or(rest) AS rest_left_out, bool_or(cut) AS end_left_out, sum(s) FILTER (k < b) AS travel FROM fall WHERE k BETWEEN a AND b AND b - a + 1 >= 6 GROUP BY name, run HAVING median(s) FILTER (k < b) >= 2)"""


@query(with_(MOVING, _FALL_SQL) + 'SELECT name, "first", "last", rest_left_out, end_left_out, round(travel, 6) AS travel FROM sums QUALIFY row_number() OVER (PARTITION BY name ORDER BY travel DESC, "first") = 1')
def free_falls(spark, sf):
    """The longest steady flight of each moving point."""
    cameras = spark.createDataFrame([(f"c{c}", c, off, rate, 1280, 720) for c, (rate, off) in enumerate(TRUE)], "camera string, ord int, offset double, rate double, width int, height int")
    return falls.falls(sampled(moving_tracks(spark, sf), cameras), cameras).select("name", "first", "last", "rest_left_out", "end_left_out", F.round("travel", 6).alias("travel"))
