"""Registered queries over state machines: the shared cells as animals, people and spots, and the loss machine's oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionframe.plans.adapter import CELLS, HEIGHT, WIDTH, cells, with_
from motionframe.plans.motion import ORACLE, query, r6
from motionframe.streaming import machines

# ---- animals --------------------------------------------------------------------------------------------------

_ANIMALS = """a AS (SELECT camera, name, frame, CASE WHEN hidden THEN 0 ELSE 40 END AS area, CASE WHEN event_id % 13 < 9 THEN confidence - 0.6 ELSE confidence END AS score, x / 3 AS cx, y AS cy, 10 + event_id % 8 AS w, 12 + event_id % 5 AS h, event_id % 29 = 0 AS prompted,
    row_number() OVER (PARTITION BY camera, name ORDER BY frame) AS i FROM cells)"""


@query(with_(CELLS, _ANIMALS).replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (
    SELECT camera, name, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST([] AS STRUCT(f BIGINT, x DOUBLE, y DOUBLE, s DOUBLE)[]) AS hist, CAST(NULL AS BIGINT) AS since, 0 AS absent, false AS ended, CAST(NULL AS BIGINT) AS stop, CAST(NULL AS VARCHAR) AS why FROM (SELECT DISTINCT camera, name FROM a)
    UNION ALL
    SELECT camera, name, i, frame, CASE WHEN idle OR other OR NOT shown THEN h ELSE list_append(h, {'f': frame, 'x': cx, 'y': cy, 's': size})[-6:] END, CASE WHEN idle OR other THEN s1 WHEN present THEN NULL ELSE coalesce(s1, frame) END,
        CASE WHEN idle OR other THEN n1 WHEN present THEN 0 ELSE n1 + 1 END, idle OR other OR (NOT present AND n1 + 1 >= 16), CASE WHEN idle THEN NULL WHEN other THEN h[-1].f + 1 WHEN NOT present AND n1 + 1 >= 16 THEN coalesce(s1, frame) END,
        CASE WHEN idle THEN NULL WHEN other THEN 'switched' WHEN NOT present AND n1 + 1 >= 16 THEN 'lost' END
    FROM (SELECT *, NOT idle AND shown AND len(h) > 0 AND coalesce(sqrt(pow(cx - h[-1].x - vx * gap, 2) + pow(cy - h[-1].y - vy * gap, 2)) > CASE WHEN gap <= 1 THEN 4.0 * (body + sqrt(vx*vx + vy*vy)) ELSE 2.0 * body + sqrt(vx*vx + vy*vy) * gap END, false) AS other FROM (
        SELECT *, shown AND score > 0 AS present, CASE WHEN h[-1].f > h[1].f THEN (h[-1].x - h[1].x) / (h[-1].f - h[1].f) ELSE 0 END AS vx, CASE WHEN h[-1].f > h[1].f THEN (h[-1].y - h[1].y) / (h[-1].f - h[1].f) ELSE 0 END AS vy,
            frame - h[-1].f AS gap, list_aggregate(list_transform(h, lambda q: q.s), 'median') AS body
        FROM (SELECT a.*, area > 0 AS shown, sqrt(pow(w + 1, 2) + pow(h_ + 1, 2)) AS size, m.ended AND NOT prompted AS idle, CASE WHEN prompted THEN [] ELSE hist END AS h, CASE WHEN prompted THEN NULL ELSE since END AS s1, CASE WHEN prompted THEN 0 ELSE absent END AS n1
              FROM m JOIN (SELECT * EXCLUDE (h), h AS h_ FROM a) a ON a.camera = m.camera AND a.name = m.name AND a.i = m.i + 1))))
    SELECT camera, name, stop AS frame, frame AS seen_at, why FROM m WHERE why IS NOT NULL""")
def animal_presence(spark, sf):
    """Where an animal's run ends, and why."""
    i = F.col("event_id")
    w, h = 10 + i % 8, 12 + i % 5
    d = cells(spark, sf).select(
        "camera", "name", "frame", F.when(F.col("hidden"), 0).otherwise(40).alias("area"), F.when(i % 13 < 9, F.col("confidence") - 0.6).otherwise(F.col("confidence")).alias("score"), (F.col("x") / 3).alias("cx"), F.col("y").alias("cy"),
        F.lit(0).alias("x0"), F.lit(0).alias("y0"), w.alias("x1"), h.alias("y1"), (i % 29 == 0).alias("prompted"),
    )
    return machines.in_batch(d, ("camera", "name"), machines.AnimalPresence)


# ---- people and spots -----------------------------------------------------------------------------------------


@query(None)
def people_columns(spark, sf):
    """Up to five boxes a frame of each landmark, given to three columns."""
    x, y = F.col("x") / 2, F.col("y") * 2
    d = cells(spark, sf).where("not hidden").select("name", "frame", F.ascii("camera").cast("long").alias("person"), x.alias("x0"), y.alias("y0"), (x + 40 + F.col("event_id") % 7).alias("x1"), (y + 50 + F.col("event_id") % 11).alias("y1"))
    return machines.in_batch(d, ("name",), lambda: machines.PeopleColumns(3))


@query(None)
def moving_spots(spark, sf):
    """Spots followed through the candidates of all cameras."""
    d = cells(spark, sf).select("name", "frame", (F.col("x") / 2).alias("x"), F.col("y").alias("y"), (F.col("confidence") + 0.1).alias("strength"), F.lit(0.02).alias("noise"), (F.col("event_id") % 17 == 0).alias("seed"))
    return machines.in_batch(d, ("name",), lambda: machines.MovingSpot(float(WIDTH), float(HEIGHT), 30.0)).select("name", "frame", r6("x"), r6("y"), r6("confidence"), "stopped")


#: The loss machine row by row: every row settles a span of frames, the last row that settles a frame counts.
ORACLE["loss_machine"] = with_(CELLS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", a AS (SELECT camera, name, frame, confidence, x >= -0.5 AND x < 519.5 AND y >= -0.5 AND y < {HEIGHT} - 0.5 AS inside, row_number() OVER (PARTITION BY camera, name ORDER BY frame) AS i FROM cells),
    m AS (SELECT camera, name, CAST(0 AS BIGINT) AS i, false AS lost, CAST(-1 AS BIGINT) AS first, 0 AS n, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM (SELECT DISTINCT camera, name FROM a)
        UNION ALL
        SELECT camera, name, i, CASE WHEN k >= 16 THEN NOT lost ELSE lost END, f, CASE WHEN k >= 16 THEN 0 ELSE k END, CASE WHEN k >= 16 THEN f ELSE frame END, frame
        FROM (SELECT a.camera, a.name, a.i, a.frame, m.lost, CASE WHEN NOT inside THEN n WHEN (confidence < 0.25) = m.lost THEN 0 ELSE n + 1 END AS k, CASE WHEN inside AND (confidence < 0.25) <> m.lost AND n = 0 THEN frame ELSE first END AS f
              FROM m JOIN a ON a.camera = m.camera AND a.name = m.name AND a.i = m.i + 1))
    SELECT a.camera, a.name, a.frame, arg_max(m.lost, m.i) AS lost FROM a JOIN m ON m.camera = a.camera AND m.name = a.name AND a.frame BETWEEN m.lo AND m.hi GROUP BY a.camera, a.name, a.frame"""
