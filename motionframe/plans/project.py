"""Registered queries over project tables, each with its oracle in DuckDB SQL.

Cameras of a rig are the suppliers, landmarks of a camera letters given to the nations of a region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.operators import alignment, project, runs
from motionframe.plans.adapter import CAMERA, CAMERAS, CELLS, HEIGHT, OBSERVED, WIDTH, cameras, cells, observations, read, with_
from motionframe.plans.motion import _RUN, _SAMPLED, _SLOPE, _SPANS, _gap_sql, _sampled, query, r6

FRAMES = 360
NAMES = [f"lm{i}" for i in range(8)]

RIG = """rig AS (SELECT 's' || s_suppkey AS camera, CAST(s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS INTEGER) AS ord, s_acctbal / 100 AS "offset", 1 + s_nationkey / 25.0 AS rate,
    CAST(24 + s_nationkey % 6 AS DOUBLE) AS fps, 300 AS n_frames, CASE WHEN s_nationkey >= 0 THEN CAST(s_suppkey % 97 + 0.5 AS DOUBLE) END AS seconds FROM supplier)"""
LANDMARK = """lm AS (SELECT n_regionkey AS camera, substr('ABCDEFGHI', 1 + n_nationkey * 7 % 9, 1) AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY min(n_nationkey)) - 1 AS INTEGER) AS ord FROM nation GROUP BY n_regionkey, substr('ABCDEFGHI', 1 + n_nationkey * 7 % 9, 1))"""
ORDERED = """o AS (SELECT name, CAST(row_number() OVER (ORDER BY min(CASE WHEN camera = 0 THEN 0 ELSE 1 END), min(camera * 1000 + ord)) - 1 AS INTEGER) AS ord FROM lm GROUP BY name)"""


def rig(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    low = s.agg(F.min("s_suppkey").alias("low"))
    return s.join(F.broadcast(low)).select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("camera"), (F.col("s_suppkey") - F.col("low")).cast("int").alias("ord"), (F.col("s_acctbal") / 100).alias("offset"), (1 + F.col("s_nationkey") / 25.0).alias("rate"),
        (24.0 + F.col("s_nationkey") % 6).alias("fps"), F.lit(300).alias("n_frames"), (F.col("s_suppkey") % 97 + 0.5).alias("seconds"),
    )


def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("camera"), F.expr("substr('ABCDEFGHI', 1 + n_nationkey * 7 % 9, 1)").alias("name")).agg(F.min("n_nationkey").alias("k"))
    return n.select("camera", "name", (F.row_number().over(Window.partitionBy("camera").orderBy("k")) - 1).alias("ord"))


# ---- clocks ---------------------------------------------------------------------------------------------------


@query(with_(RIG) + """, f AS (SELECT camera, fps / 24.0 AS r FROM rig), d AS (SELECT unnest(range(1, 1001)) AS d),
    q AS (SELECT camera, any_value(r) AS r, arg_min(round(r * d) / d, d) FILTER (abs(round(r * d) / d - r) <= 1e-9 * r) AS q FROM f JOIN d ON true GROUP BY camera)
    SELECT camera, round(coalesce(q, r), 9) AS rate FROM q""")
def rate_fractions(spark, sf):
    return rig(spark, sf).select("camera", F.round(project.rate_of(F.col("fps"), F.lit(24.0)), 9).alias("rate"))


@query(with_(RIG) + """SELECT camera, round(CASE WHEN ord % 2 = 1 THEN ord * 0.5 ELSE "offset" END, 6) AS "offset", round(CASE WHEN ord % 3 = 1 AND ord <> 0 THEN 1.25 ELSE rate END, 6) AS rate FROM rig""")
def clocks_set(spark, sf):
    d = project.with_offset(rig(spark, sf), F.col("ord") % 2 != 2, F.when(F.col("ord") % 2 == 1, F.col("ord") * 0.5))
    return project.with_rate(d, F.col("ord") % 3 == 1, F.lit(1.25)).select("camera", r6("offset"), r6("rate"))


def _fps_sql(order: int, fps: float) -> str:
    by = f"{fps} / (SELECT fps FROM rig WHERE ord = {order})"
    rate = f"CASE WHEN ord <> 0 THEN rate / ({by}) ELSE rate END" if order == 0 else f"CASE WHEN ord = {order} THEN rate * ({by}) ELSE rate END"
    return with_(RIG) + f"SELECT camera, round({rate}, 6) AS rate, CAST(CASE WHEN ord = {order} THEN {fps} ELSE fps END AS DOUBLE) AS fps FROM rig"


@query(_fps_sql(0, 240.0))
def reference_fps_set(spark, sf):
    return project.with_fps(rig(spark, sf), 0, 240.0).select("camera", r6("rate"), "fps")


@query(_fps_sql(3, 120.0))
def camera_fps_set(spark, sf):
    return project.with_fps(rig(spark, sf), 3, 120.0).select("camera", r6("rate"), "fps")


@query(with_(RIG) + """SELECT camera, round(CASE WHEN ord = 0 THEN 0 ELSE ((SELECT seconds FROM rig WHERE ord = 0) - seconds) * fps END, 6) AS "offset" FROM rig""")
def timecode_offsets(spark, sf):
    return project.timecode_offsets(rig(spark, sf)).select("camera", r6("offset"))


@query(with_(CELLS, CAMERA, _SPANS) + f""", e AS (SELECT lo AS t, 0 AS k, 1 AS d FROM spans UNION ALL SELECT hi, 1, -1 FROM spans),
    s AS (SELECT t, d, coalesce(sum(d) OVER (ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e),
    w AS (SELECT min(t) FILTER (b + d >= 2 AND b < 2) AS lo, max(t) FILTER (b >= 2 AND b + d < 2) AS hi FROM s),
    l AS (SELECT camera, greatest(CAST(ceil(rate * lo + off - 1e-9) AS BIGINT), 0) AS a, least(CAST(floor(rate * hi + off + 1e-9) AS BIGINT), {FRAMES - 1}) AS b FROM camera CROSS JOIN w)
    SELECT camera, CASE WHEN a <= b THEN a ELSE 0 END AS "first", CASE WHEN a <= b THEN b ELSE -1 END AS "last" FROM l""")
def local_coverage_k2(spark, sf):
    span = alignment.covered_span(alignment.spans(cells(spark, sf), cameras(spark)), 2)
    return project.local_coverage(span, cameras(spark).withColumn("n_frames", F.lit(FRAMES).cast("long")))


# ---- landmarks and segments -------------------------------------------------------------------------------------


@query(with_(LANDMARK, ORDERED) + "SELECT name, ord FROM o")
def landmark_order(spark, sf):
    return project.landmark_order(landmarks(spark, sf))


@query(with_(LANDMARK) + "SELECT c.camera, n.name FROM (SELECT DISTINCT camera FROM lm) c CROSS JOIN (SELECT DISTINCT name FROM lm) n ANTI JOIN lm USING (camera, name)")
def missing_by_camera(spark, sf):
    return project.missing(landmarks(spark, sf))


@query(with_(LANDMARK) + """, s AS (SELECT camera, CASE WHEN camera % 2 = 0 THEN lower(name) ELSE name END AS name, ord FROM lm), f AS (SELECT lower(name) AS k, arg_min(name, camera * 1000 + ord) AS name FROM s GROUP BY 1)
    SELECT c.camera, f.name FROM (SELECT DISTINCT camera FROM s) c CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.camera = c.camera AND lower(s.name) = f.k)""")
def missing_segments(spark, sf):
    return project.missing_segments(landmarks(spark, sf).withColumn("name", F.when(F.col("camera") % 2 == 0, F.lower("name")).otherwise(F.col("name"))))


@query(with_(LANDMARK, ORDERED) + "SELECT camera, name, o.ord FROM (SELECT DISTINCT camera FROM lm) CROSS JOIN o")
def landmarks_synchronized(spark, sf):
    return project.synchronized(landmarks(spark, sf))


@query(with_(LANDMARK, ORDERED) + "SELECT DISTINCT c.camera FROM (SELECT DISTINCT camera FROM lm) c CROSS JOIN o LEFT JOIN lm ON lm.camera = c.camera AND lm.name = o.name WHERE lm.ord IS DISTINCT FROM o.ord")
def landmark_changes(spark, sf):
    return project.changed_cameras(landmarks(spark, sf))


@query(with_(LANDMARK) + "SELECT camera, name, CAST(row_number() OVER (PARTITION BY camera ORDER BY CASE name WHEN 'H' THEN 1 WHEN 'B' THEN 2 ELSE 3 END, ord) - 1 AS INTEGER) AS ord FROM lm")
def landmarks_reordered(spark, sf):
    return project.reordered(landmarks(spark, sf), ["H", "B"])


@query(with_(LANDMARK) + "SELECT camera, name, CASE WHEN name IN ('H', 'C') THEN 'Fox' WHEN ord % 2 = 0 THEN 'Owl' END AS animal FROM lm")
def landmarks_assigned(spark, sf):
    d = landmarks(spark, sf).withColumn("animal", F.when(F.col("ord") % 2 == 0, F.lit("Owl")))
    return project.assigned(d, ["H", "C"], "Fox").select("camera", "name", "animal")


@query(with_(LANDMARK) + "SELECT camera, name FROM lm WHERE ord % 2 <> 0")
def segment_removed(spark, sf):
    d = landmarks(spark, sf).withColumn("animal", F.when(F.col("ord") % 2 == 0, F.lit("Owl")))
    return project.without_segment(d, "owl").select("camera", "name")


# ---- notes and rows ---------------------------------------------------------------------------------------------

_NOTES = "notes AS (SELECT camera, frame, min(name) AS text, 'a' AS author FROM cells WHERE frame % 5 = 0 GROUP BY camera, frame), fresh AS (SELECT camera, frame, CASE WHEN frame % 3 = 0 THEN ' ' ELSE 'new' END AS text, 'b' AS author FROM cells WHERE frame % 7 = 0 GROUP BY camera, frame)"


@query(with_(CELLS, _NOTES) + "SELECT * FROM notes ANTI JOIN fresh USING (camera, frame) UNION ALL SELECT camera, frame, trim(text), author FROM fresh WHERE trim(text) <> ''")
def notes_set(spark, sf):
    c = cells(spark, sf)
    notes = c.where("frame % 5 = 0").groupBy("camera", "frame").agg(F.min("name").alias("text")).withColumn("author", F.lit("a"))
    fresh = c.where("frame % 7 = 0").select("camera", "frame").distinct().withColumns({"text": F.when(F.col("frame") % 3 == 0, " ").otherwise("new"), "author": F.lit("b")})
    return project.noted(notes, fresh)


@query(with_(CELLS) + "SELECT camera, max(frame) AS last_frame FROM cells GROUP BY camera")
def last_tracked_frames(spark, sf):
    return project.last_tracked(cells(spark, sf))


@query(with_(OBSERVED) + "SELECT name, frame, cam, count(*) OVER (PARTITION BY name, frame) - 1 AS others FROM observed")
def other_views(spark, sf):
    return project.other_views(observations(spark, sf)).select("name", "frame", "cam", "others")


# ---- plans of runs ----------------------------------------------------------------------------------------------

_CLICKS = f"clicks AS (SELECT * FROM cells WHERE hand_placed AND visible AND NOT hidden AND x >= -0.5 AND x < {WIDTH} - 0.5 AND y >= -0.5 AND y < {HEIGHT} - 0.5)"
_IN_RUN = "own AS (SELECT * FROM clicks WHERE frame >= 20 AND frame < 340)"


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    return project.usable_clicks(cells(spark, sf), WIDTH, HEIGHT)


@query(with_(CELLS, _CLICKS, _IN_RUN, _gap_sql("own", "camera, name", 2)) + """, s AS (SELECT camera, name, "end" AS restart, coalesce(lead("start") OVER (PARTITION BY camera, name ORDER BY "start"), 340) - 1 AS "last" FROM joined WHERE "end" > 20)
    SELECT s.camera, s.name, restart, "last", x, y FROM s JOIN own ON own.camera = s.camera AND own.name = s.name AND own.frame = restart""")
def hand_plan(spark, sf):
    return project.hand_plan(_clicks(spark, sf), 20, 340)


@query(with_(CELLS, _CLICKS, _IN_RUN, _gap_sql("own", "camera, name", 2)) + """SELECT k.camera, k.name, coalesce(min("start") - 1, 339) AS "last" FROM (SELECT DISTINCT camera, name FROM clicks) k
    LEFT JOIN joined j ON j.camera = k.camera AND j.name = k.name AND j."end" > 20 GROUP BY k.camera, k.name""")
def first_stops(spark, sf):
    return project.first_stop(_clicks(spark, sf), 20, 340)


@query(with_(CELLS) + """, r AS (SELECT *, frame - row_number() OVER (PARTITION BY camera, name ORDER BY frame) AS g FROM cells WHERE NOT hidden),
    s AS (SELECT *, row_number() OVER w AS i, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM r WINDOW w AS (PARTITION BY camera, name, g ORDER BY frame)),
    v AS (SELECT *, list(dx) FILTER (dx IS NOT NULL) OVER w AS xs, list(dy) FILTER (dy IS NOT NULL) OVER w AS ys FROM s WINDOW w AS (PARTITION BY camera, name, g ORDER BY frame ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, list_reduce(xs, lambda a, c: 0.5 * a + 0.5 * c) AS vx, list_reduce(ys, lambda a, c: 0.5 * a + 0.5 * c) AS vy FROM v WHERE i > 2)
    SELECT camera, name, frame, round(sqrt((dx - vx) * (dx - vx) + (dy - vy) * (dy - vy)), 6) AS miss, round(sqrt(vx * vx + vy * vy), 6) AS speed FROM b""")
def click_motion(spark, sf):
    return project.click_motion(cells(spark, sf).where("not hidden")).select("camera", "name", "frame", r6("miss"), r6("speed"))


@query(with_(CELLS, _RUN) + """, t AS (SELECT camera, min(frame) AS a, max(frame) AS b, 1 + count(*) % 4 AS step FROM isl GROUP BY camera, name, g), q AS (SELECT camera, step, unnest(range(a, b + 1, step)) AS frame FROM t)
    SELECT c.camera, c.frame, coalesce(min(step), 9) AS step FROM (SELECT DISTINCT camera, frame FROM cells) c LEFT JOIN q USING (camera, frame) GROUP BY c.camera, c.frame""")
def frame_steps(spark, sf):
    c = cells(spark, sf)
    sampled = runs.runs(c).select("camera", "start", "end", (1 + F.col("n") % 4).alias("step"))
    return project.frame_steps(c.select("camera", "frame").distinct(), sampled, 9)


# ---- instants ---------------------------------------------------------------------------------------------------


def _views_sql(shift: float = 0.0) -> str:
    return f"""(WITH pos AS (SELECT t, camera, ord, rate * t + off + CASE WHEN ord <> 0 THEN {shift} ELSE 0 END AS x FROM camera CROSS JOIN (SELECT unnest(range(0, {FRAMES})) AS t)),
        lo AS (SELECT *, CAST(floor(x) AS BIGINT) AS f0, x - floor(x) < 1e-9 OR x - floor(x) > 1 - 1e-9 AS whole FROM pos),
        need AS (SELECT t, camera, unnest(CASE WHEN whole THEN [f0 + CASE WHEN x - f0 > 0.5 THEN 1 ELSE 0 END] ELSE [f0, f0 + 1] END) AS frame, CASE WHEN whole THEN 1 ELSE 2 END AS k, f0 FROM lo)
        SELECT need.t, need.camera, name, any_value(k) AS k, count(*) AS n, min(frame) AS has, any_value(f0) AS f0 FROM need JOIN (SELECT * FROM cells WHERE NOT hidden) c USING (camera, frame) GROUP BY need.t, need.camera, name)"""


@query(with_(CELLS, CAMERA) + f"SELECT t, camera, name, n < k AS half, CASE WHEN n < k THEN has END AS has, CASE WHEN n < k THEN CASE WHEN has = f0 THEN f0 + 1 ELSE f0 END END AS lacks FROM {_views_sql()}")
def sampled_views(spark, sf):
    return project.sampled_views(cells(spark, sf), cameras(spark), 0, FRAMES - 1).withColumn("t", F.col("t").cast("long"))


@query(with_(CELLS, CAMERA) + "SELECT t, camera, name FROM (" + " UNION ALL ".join(f"SELECT t, camera, name FROM {_views_sql(s)} WHERE n = k" for s in (-1.5, 0.0, 1.5)) + ") GROUP BY t, camera, name HAVING count(*) = 3")
def stable_cells(spark, sf):
    return project.stable_cells(cells(spark, sf), cameras(spark), 0, FRAMES - 1, 1.5).withColumn("t", F.col("t").cast("long"))


_BOTH = "both_seen AS (SELECT camera, t FROM sampled WHERE name IN ('lm1', 'lm2') GROUP BY camera, t HAVING count(DISTINCT name) = 2)"


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.pairs_seen(_sampled(spark, sf), "lm1", "lm2").select("camera", "t")


@query(with_(CELLS, CAMERA, _SAMPLED, _BOTH) + "SELECT a.camera AS a, b.camera AS b, count(*) AS n FROM both_seen a JOIN both_seen b ON a.t = b.t AND a.camera < b.camera GROUP BY 1, 2")
def shared_pairs(spark, sf):
    return project.shared_pairs(_both(spark, sf))


@query(with_(CELLS, CAMERA, _SAMPLED, _BOTH).replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT a.camera AS a, b.camera AS b FROM both_seen a JOIN both_seen b ON a.t = b.t AND a.camera <> b.camera GROUP BY 1, 2 HAVING count(*) >= 3),
    r(a, b) AS (SELECT DISTINCT camera, camera FROM both_seen UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS camera, min(b) AS "group" FROM r GROUP BY a""")
def camera_groups(spark, sf):
    return project.camera_groups(_both(spark, sf), 3)


@query(with_(CELLS, CAMERA, _SAMPLED, _BOTH) + ", o AS (SELECT *, count(*) OVER (PARTITION BY t) - 1 AS k FROM both_seen) SELECT camera, count(*) AS instants, count(*) FILTER (k > 0) AS shared, count(*) FILTER (k > 0) >= 3 AS ticked FROM o GROUP BY camera")
def camera_ticks(spark, sf):
    return project.camera_ticks(_both(spark, sf), 3)


# ---- reports and exports ------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority AS k, round(greatest(500, 3 * median(o_totalprice % 1000)), 4) AS \"limit\" FROM orders GROUP BY 1")
def outlier_limits(spark, sf):
    d = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") % 1000).alias("error"))
    return project.outlier_limits(d, 500.0, ("k",)).select("k", F.round("limit", 4).alias("limit"))


@query(with_(CELLS, _RUN, _SLOPE) + """, k AS (SELECT camera, name, CASE WHEN frame - min(frame) OVER e >= 1 AND max(frame) OVER e - frame >= 1 THEN abs(v) END AS s,
    CASE WHEN frame - min(frame) OVER e >= 1 AND max(frame) OVER e - frame >= 1 AND n > 2 THEN abs(lead(v) OVER w - lag(v) OVER w) * 50.0 END AS a FROM vel WINDOW w AS (PARTITION BY camera, name, g ORDER BY frame), e AS (PARTITION BY camera, name, g))
    SELECT camera, name, count(*) AS n, round(max(s), 3) AS peak_speed, round(median(s), 3) AS median_speed, round(max(a), 2) AS peak_acceleration FROM k GROUP BY camera, name""")
def kinematics(spark, sf):
    d = runs.derivatives(runs.edge_mask(cells(spark, sf), 1), 100.0, ("x",))
    return project.kinematics(d, 1).select("camera", "name", "n", F.round("peak_speed", 3).alias("peak_speed"), F.round("median_speed", 3).alias("median_speed"), F.round("peak_acceleration", 2).alias("peak_acceleration"))


_ERRORS = "e AS (SELECT camera AS cam, name, frame, abs(x - 20) AS error FROM cells)"


@query(with_(CELLS, _ERRORS, "hot AS (SELECT * FROM e WHERE error > 30)", _gap_sql("hot", "cam, name", 8)) + """SELECT count(error) AS n_cells, round(median(error), 6) AS median_error, round(max(error), 6) AS max_error, count(*) FILTER (error > 30) AS n_over
    FROM e SEMI JOIN (SELECT DISTINCT cam, name, unnest(range("start", "end" + 1)) AS frame FROM joined) USING (cam, name, frame)""")
def flagged_cells(spark, sf):
    e = cells(spark, sf).select(F.col("camera").alias("cam"), "name", "frame", F.abs(F.col("x") - 20).alias("error"))
    hot = runs.runs(e.where("error > 30"), ("cam", "name"), 8)
    return project.flagged_cells(e, hot, 30.0).select("n_cells", r6("median_error"), r6("max_error"), "n_over")


@query("""SELECT k, unnest(list_filter([CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'lens' END, CASE WHEN count(DISTINCT c_nationkey % 1) > 1 THEN 'fps' END,
    CASE WHEN max(c_acctbal) FILTER (c_acctbal > 0) / min(c_acctbal) FILTER (c_acctbal > 0) >= 2 THEN 'shutter' END], lambda s: s IS NOT NULL)) AS setting FROM (SELECT *, c_custkey // 3 AS k FROM customer) GROUP BY k""")
def setting_problems(spark, sf):
    d = read(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 3).alias("rig"), F.col("c_mktsegment").alias("lens"), (F.col("c_nationkey") % 1).alias("fps"), F.col("c_acctbal").alias("shutter"))
    return project.setting_problems(d, ["lens", "fps"], "rig", 2.0, "shutter").select(F.col("rig").alias("k"), "setting")


_WIDE = ", ".join(f"max(CASE WHEN name = '{n}' AND ord = {k} THEN {c} END) AS pt{i + 1}_cam{k + 1}_{c.upper()}" for i, n in enumerate(NAMES) for k in range(len(CAMERAS)) for c in "xy")


@query(with_(CELLS, CAMERA) + f""", s AS (SELECT t, camera, ord, CAST(floor(rate * t + off + 0.5) AS BIGINT) AS frame FROM camera CROSS JOIN (SELECT unnest(range(0, {FRAMES})) AS t)),
    r AS (SELECT t, ord, name, c.x + 1 AS x, c.y + 1 AS y FROM s JOIN cells c USING (camera, frame) WHERE NOT hidden) SELECT CAST(t AS INTEGER) AS frame, {_WIDE} FROM r GROUP BY t""")
def all_cameras_export(spark, sf):
    return project.all_cameras_wide(project.all_cameras(cells(spark, sf), cameras(spark), FRAMES, HEIGHT), NAMES, len(CAMERAS))
