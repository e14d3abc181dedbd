"""Registered queries of the motion engine on the shared tables, each with its oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.functions import scalars as S
from motionframe.operators import alignment, edits, hull, reshape, runs, triangulation
from motionframe.plans.adapter import CAMERA, CELLS, DLT_SQL, HEIGHT, OBSERVED, WIDTH, calibration, cameras, cells, observations, read, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# ---- predicates and projections ------------------------------------------------------------------------


@query(with_(CELLS) + "SELECT camera, name, frame, x, y, confidence FROM cells WHERE NOT hidden")
def cells_exportable(spark, sf):
    return cells(spark, sf).where(S.exportable(F.lit(True), F.col("hidden"))).select("camera", "name", "frame", "x", "y", "confidence")


@query(with_(CELLS) + f"SELECT camera, name, frame, x, y FROM cells WHERE x >= -0.5 AND x < {WIDTH} - 0.5 AND y >= -0.5 AND y < {HEIGHT} - 0.5")
def cells_in_frame(spark, sf):
    return cells(spark, sf).where(S.in_frame(F.col("x"), F.col("y"), F.lit(WIDTH), F.lit(HEIGHT))).select("camera", "name", "frame", "x", "y")


@query(with_(CELLS) + f"""SELECT camera, name, frame,
    round(sqrt(pow(greatest(-0.5 - x, x - ({WIDTH} - 0.5), 0), 2) + pow(greatest(-0.5 - y, y - ({HEIGHT} - 0.5), 0), 2)), 6) AS outside,
    CASE WHEN x < -0.5 THEN 0 WHEN x >= {WIDTH} - 0.5 THEN {WIDTH} - 1 ELSE x END AS cx FROM cells""")
def cells_outside_by(spark, sf):
    w, h = F.lit(float(WIDTH)), F.lit(float(HEIGHT))
    return cells(spark, sf).select("camera", "name", "frame", r6(S.outside_by(F.col("x"), F.col("y"), w, h), "outside"), S.onto_picture(F.col("x"), w).alias("cx"))


@query(with_(CELLS) + f"SELECT camera, name, frame + 1 AS frame, x + 1 AS x, {HEIGHT} - y AS y FROM cells WHERE NOT hidden")
def export_one_based(spark, sf):
    return reshape.one_based(cells(spark, sf), HEIGHT)


#: Names as they are met, and the key each must get.
_SPELLED = (("Stra\u00dfe", "strasse"), ("\u017fam", "sam"), ("\u00a0NOSE,tip", "nose_tip"), ("\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2", "\u03c3\u03af\u03c3\u03c5\u03c6\u03bf\u03c3"), ("\ufb03n", "ffin"), ("\u0131x", "\u0131x"), (" \t ", "_"), ("\u3000", "point"), ("\u1e9e", "ss"))


@query("SELECT s_suppkey, CASE s_suppkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_SPELLED)) + " END || CASE WHEN s_suppkey % 9 IN (6, 7) THEN '' ELSE ' ' || regexp_extract(s_name, '[0-9]+') END AS k FROM supplier")
def name_keys(spark, sf):
    s = read(spark, sf, "supplier")
    i = (F.col("s_suppkey") % 9).cast("int")
    spelled = F.get(F.array(*(F.lit(n) for n, _ in _SPELLED)), i)
    number = F.when(i.isin(6, 7), "").otherwise(F.concat(F.lit(" "), F.regexp_extract("s_name", "[0-9]+", 0), F.lit("\u2009")))
    return s.select("s_suppkey", S.name_key(F.concat(spelled, number)).alias("k"))


@query(with_(CELLS, CAMERA) + """SELECT camera, name, frame,
    CAST(CASE WHEN ord <= 0 THEN floor((frame - off) / rate + 0.5) ELSE ceil((frame - off) / rate - 0.5) END AS BIGINT) AS reference_frame
    FROM cells JOIN camera USING (camera)""")
def clock_map_back(spark, sf):
    return alignment.on_reference(cells(spark, sf), cameras(spark)).select("camera", "name", "frame", "reference_frame")


@query(with_(CELLS, CAMERA) + """, m AS (SELECT c.camera, name, frame, 2.0 * ((frame - off) / rate) + 7.0 AS x, ord FROM cells c JOIN camera USING (camera)),
    t AS (SELECT camera, name, frame, CAST(CASE WHEN ord <= 3 THEN floor(x + 0.5) ELSE ceil(x - 0.5) END AS BIGINT) AS k FROM m)
    SELECT camera, name, frame, CASE WHEN k >= 0 AND k < 400 THEN k END AS target_frame FROM t""")
def clock_map_forward(spark, sf):
    return alignment.mapped(cells(spark, sf), cameras(spark), "signup", 400).select("camera", "name", "frame", "target_frame")


@query("SELECT e1.vec_id AS vec_id, round(least(greatest((w*h) / (a + b - w*h), 0), 1), 6) AS iou FROM (SELECT vec_id, greatest(least(e[1], e[3]) + 1 - greatest(e[1], e[3]), 0) AS w, greatest(least(e[2], e[4]) + 1 - greatest(e[2], e[4]), 0) AS h, 1.0 AS a, 1.0 AS b FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) e1")
def box_overlaps(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    at = lambda i: F.get("e", F.lit(i))
    return e.select("vec_id", r6(S.box_overlap([at(0), at(1), at(0) + 1, at(1) + 1], [at(2), at(3), at(2) + 1, at(3) + 1]), "iou"))


@query("SELECT p_partkey, round(1 / (1 + pow(tan(pi() * f / 100) / tan(pi() * 10.0 / 100), 4)), 6) AS kept, CAST(ceil(100 / f) AS BIGINT) AS width, round(1 / (1 + exp(-(f - 2))), 6) AS conf FROM (SELECT p_partkey, 1.0 + p_partkey % 40 AS f FROM part)")
def filter_gains(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", (1.0 + F.col("p_partkey") % 40).alias("f"))
    return d.select("p_partkey", r6(S.kept_fraction(F.col("f"), F.lit(10.0), F.lit(100.0)), "kept"), S.edge_width(F.lit(100.0), F.col("f")).alias("width"), r6(S.score_to_confidence(F.col("f")), "conf"))


# ---- runs ------------------------------------------------------------------------------------------------

_RUN = "isl AS (SELECT *, frame - row_number() OVER (PARTITION BY camera, name ORDER BY frame) AS g FROM cells)"
_RUNS = "SELECT camera, name, min(frame) AS \"start\", max(frame) AS \"end\", count(*) AS n FROM isl GROUP BY camera, name, g"


@query(with_(CELLS, _RUN) + _RUNS)
def contiguous_runs(spark, sf):
    return runs.runs(cells(spark, sf))


def _gap_sql(source: str, keys: str, gap: int, least: int = 1) -> str:
    return f"""lagged AS (SELECT {keys}, frame, lag(frame) OVER (PARTITION BY {keys} ORDER BY frame) AS p FROM {source}),
    grp AS (SELECT {keys}, frame, sum(CASE WHEN p IS NULL OR frame - p > {gap + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY frame) AS g FROM lagged),
    joined AS (SELECT {keys}, min(frame) AS "start", max(frame) AS "end", count(*) AS n FROM grp GROUP BY {keys}, g HAVING max(frame) - min(frame) + 1 >= {least})"""


@query(with_(CELLS, _gap_sql("cells", "camera, name", 2, 3)) + "SELECT * FROM joined")
def runs_gap_joined(spark, sf):
    return runs.runs(cells(spark, sf), max_gap=2, least=3)


@query(with_(CELLS, "low AS (SELECT camera, frame FROM cells WHERE NOT hidden GROUP BY camera, frame HAVING bool_or(confidence < 0.25))", _gap_sql("low", "camera", 0)) + "SELECT * FROM joined")
def low_confidence_runs(spark, sf):
    return runs.low_confidence_runs(cells(spark, sf), 0.25)


@query(with_(CELLS, "low AS (SELECT camera, frame FROM cells WHERE NOT hidden GROUP BY camera, frame HAVING bool_or(confidence < 0.25))", _gap_sql("low", "camera", 0)) + "SELECT camera, min(\"start\") AS \"start\", arg_min(\"end\", \"start\") AS \"end\" FROM joined WHERE \"start\" > 100 GROUP BY camera")
def next_low_confidence(spark, sf):
    return runs.next_run(runs.low_confidence_runs(cells(spark, sf), 0.25), 100)


@query(with_(CELLS) + """SELECT camera, name, frame,
    max(CASE WHEN hand_placed THEN frame END) OVER (PARTITION BY camera, name ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_hand,
    min(CASE WHEN hand_placed THEN frame END) OVER (PARTITION BY camera, name ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_hand FROM cells""")
def next_hand_placed(spark, sf):
    return runs.next_hand_placed(cells(spark, sf))


@query(with_(CELLS, _RUN) + "SELECT camera, name, frame, frame - min(frame) OVER w < 2 OR max(frame) OVER w - frame < 2 AS edge FROM isl WINDOW w AS (PARTITION BY camera, name, g)")
def edge_mask(spark, sf):
    return runs.edge_mask(cells(spark, sf), 2).select("camera", "name", "frame", "edge")


_SLOPE = """num AS (SELECT *, row_number() OVER (PARTITION BY camera, name, g ORDER BY frame) AS i, count(*) OVER (PARTITION BY camera, name, g) AS n FROM isl),
    vel AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN CASE WHEN i = 1 THEN lead(x) OVER w - x ELSE x - lag(x) OVER w END * 100.0
        WHEN i = 1 THEN (-3 * x + 4 * lead(x) OVER w - lead(x, 2) OVER w) * 50.0 WHEN i = n THEN (3 * x - 4 * lag(x) OVER w + lag(x, 2) OVER w) * 50.0
        ELSE (lead(x) OVER w - lag(x) OVER w) * 50.0 END AS v FROM num WINDOW w AS (PARTITION BY camera, name, g ORDER BY frame))"""


@query(with_(CELLS, _RUN, _SLOPE) + "SELECT camera, name, frame, round(v, 4) AS v_x FROM vel")
def velocity(spark, sf):
    return runs.derivatives(cells(spark, sf), 100.0, ("x",)).select("camera", "name", "frame", F.round("v_x", 4).alias("v_x"))


@query(with_(CELLS, _RUN, _SLOPE) + """SELECT camera, name, frame, round(CASE WHEN n <= 2 THEN NULL WHEN i = 1 THEN (-3 * v + 4 * lead(v) OVER w - lead(v, 2) OVER w) * 50.0
    WHEN i = n THEN (3 * v - 4 * lag(v) OVER w + lag(v, 2) OVER w) * 50.0 ELSE (lead(v) OVER w - lag(v) OVER w) * 50.0 END, 2) AS a_x FROM vel WINDOW w AS (PARTITION BY camera, name, g ORDER BY frame)""")
def acceleration(spark, sf):
    return runs.derivatives(cells(spark, sf), 100.0, ("x",)).select("camera", "name", "frame", F.round("a_x", 2).alias("a_x"))


@query(with_(CELLS) + """, s AS (SELECT camera, name, frame, y, lag(frame) OVER w AS f0, lag(y) OVER w AS y0, lead(frame) OVER w AS f1, lead(y) OVER w AS y1 FROM cells WINDOW w AS (PARTITION BY camera, name ORDER BY frame)),
    e AS (SELECT camera, name, frame, CASE WHEN frame - f0 <= 2 THEN f0 ELSE frame END AS a, CASE WHEN frame - f0 <= 2 THEN y0 ELSE y END AS ya, CASE WHEN f1 - frame <= 2 THEN f1 ELSE frame END AS b, CASE WHEN f1 - frame <= 2 THEN y1 ELSE y END AS yb FROM s)
    SELECT camera, name, frame, CASE WHEN b > a THEN round((yb - ya) * 100.0 / (b - a), 6) END AS rate FROM e""")
def angular_velocity(spark, sf):
    return runs.angular_velocity(cells(spark, sf), "y", 100.0, 2).select("camera", "name", "frame", r6("rate"))


@query(with_(CELLS) + """, s AS (SELECT camera, name, lag(frame) OVER w + 1 AS a, frame - 1 AS b, lag(hand_placed) OVER w AS h0, hand_placed AS h1, lag(hidden) OVER w AS hid, lag(visible) OVER w AS vis FROM cells WINDOW w AS (PARTITION BY camera, name ORDER BY frame))
    SELECT camera, name, a AS "start", b AS "end", CASE WHEN hid THEN 'hidden' WHEN h0 AND h1 THEN 'between clicks' WHEN NOT vis THEN 'not visible' ELSE 'fill' END AS reason FROM s WHERE a <= b""")
def gap_plan(spark, sf):
    return runs.gap_plan(cells(spark, sf))


_HAND = _gap_sql("(SELECT * FROM cells WHERE hand_placed)", "camera, name", 2)


@query(with_(CELLS, _HAND) + "SELECT * FROM joined")
def hand_stretches(spark, sf):
    return runs.hand_stretches(cells(spark, sf))


@query(with_(CELLS, _HAND) + "SELECT camera, name, \"start\", \"end\", n FROM joined QUALIFY row_number() OVER (PARTITION BY camera, name ORDER BY n DESC, \"start\") = 1")
def longest_stretch(spark, sf):
    return runs.longest_stretch(cells(spark, sf))


@query(with_(CELLS) + """SELECT camera, name, CAST(floor(frame * 40 / 360.0) AS BIGINT) AS bucket, count(*) AS n, min(CASE WHEN NOT hidden THEN confidence END) AS min_confidence,
    bool_or(hand_placed) AS any_hand, bool_or(hidden) AS any_hidden FROM cells GROUP BY ALL""")
def timeline_buckets(spark, sf):
    return runs.timeline(cells(spark, sf), 360, 40)


_SIGNAL = "sig AS (SELECT camera AS source, frame, avg(x) AS v FROM cells GROUP BY camera, frame)"
_CLEAN = """num AS (SELECT source, frame, v, row_number() OVER w AS i, count(*) OVER (PARTITION BY source) AS n, first_value(v) OVER w AS a, last_value(v) OVER (PARTITION BY source ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b,
    sum(v) OVER (PARTITION BY source ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS s FROM sig WINDOW w AS (PARTITION BY source ORDER BY frame)),
    hp AS (SELECT source, frame, v - (s + greatest(16 - i, 0) * a + greatest(15 - (n - i), 0) * b) / 31 AS h FROM num),
    clean AS (SELECT source, frame, (h - avg(h) OVER (PARTITION BY source)) / stddev_pop(h) OVER (PARTITION BY source) AS c FROM hp)"""


def _signals(spark, sf):
    return cells(spark, sf).groupBy(F.col("camera").alias("source"), "frame").agg(F.avg("x").alias("v"))


@query(with_(CELLS, _SIGNAL, _CLEAN) + "SELECT source, frame, round(c, 4) AS clean FROM clean")
def moving_average_highpass(spark, sf):
    return runs.detrended(_signals(spark, sf), "v").select("source", "frame", F.round("clean", 4).alias("clean"))


@query(with_(CELLS) + """, t AS (SELECT *, row_number() OVER (PARTITION BY camera, name ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY camera, name) AS n FROM cells)
    SELECT camera, name, frame FROM t WHERE n <= 20 OR i = ceil(floor(i * 19 / CAST(n - 1 AS DOUBLE)) * (n - 1) / 19.0)""")
def even_thinning(spark, sf):
    return runs.evenly_thinned(cells(spark, sf), 20).select("camera", "name", "frame")


# ---- clocks and joins --------------------------------------------------------------------------------------

_SAMPLED = """spine AS (SELECT camera, name, off, rate, unnest(range(CAST(floor(min((frame - off) / rate)) - 3 AS BIGINT), CAST(ceil(max((frame - off) / rate)) + 4 AS BIGINT))) AS t
        FROM cells JOIN camera USING (camera) GROUP BY camera, name, off, rate),
    want AS (SELECT camera, name, t, rate * t + off AS f FROM spine),
    sampled AS (SELECT w.camera, w.name, w.t, CASE WHEN abs(f - floor(f + 0.5)) < 1e-9 THEN n.x ELSE (1 - (f - floor(f))) * a.x + (f - floor(f)) * b.x END AS x,
            CASE WHEN abs(f - floor(f + 0.5)) < 1e-9 THEN n.y ELSE (1 - (f - floor(f))) * a.y + (f - floor(f)) * b.y END AS y
        FROM want w LEFT JOIN cells a ON a.camera = w.camera AND a.name = w.name AND a.frame = floor(f) LEFT JOIN cells b ON b.camera = w.camera AND b.name = w.name AND b.frame = floor(f) + 1
        LEFT JOIN cells n ON n.camera = w.camera AND n.name = w.name AND n.frame = floor(f + 0.5)
        WHERE CASE WHEN abs(f - floor(f + 0.5)) < 1e-9 THEN n.x IS NOT NULL ELSE a.x IS NOT NULL AND b.x IS NOT NULL END)"""


def _sampled(spark, sf):
    return alignment.sampled(cells(spark, sf), cameras(spark))


@query(with_(CELLS, CAMERA, _SAMPLED) + "SELECT camera, name, t, round(x, 6) AS x, round(y, 6) AS y FROM sampled")
def asof_lerp(spark, sf):
    return _sampled(spark, sf).select("camera", "name", "t", r6("x"), r6("y"))


@query(with_(CELLS) + """, inst AS (SELECT DISTINCT 'view' AS camera, name, frame AS t FROM cells WHERE camera = 'click'),
    c AS (SELECT i.camera, i.name, i.t, k.frame, k.x, k.y, row_number() OVER (PARTITION BY i.camera, i.name, i.t ORDER BY abs(k.frame - i.t), k.frame DESC) AS rn
          FROM inst i JOIN cells k ON k.camera = i.camera AND k.name = i.name AND k.frame BETWEEN i.t - 3 AND i.t + 3)
    SELECT camera, name, t, frame, x, y FROM c WHERE rn = 1""")
def asof_nearest_tie_later(spark, sf):
    c = cells(spark, sf)
    instants = c.where("camera = 'click'").select(F.lit("view").alias("camera"), "name", F.col("frame").alias("t")).distinct()
    return alignment.nearest(c, instants)


@query(with_(CELLS, CAMERA, _SAMPLED) + """, near AS (SELECT w.camera, w.name, w.t, n.x, n.y FROM want w JOIN cells n ON n.camera = w.camera AND n.name = w.name AND n.frame = floor(f + 0.5))
    SELECT coalesce(s.camera, n.camera) AS camera, coalesce(s.name, n.name) AS name, coalesce(s.t, n.t) AS t, round(coalesce(s.x, n.x), 6) AS x, round(coalesce(s.y, n.y), 6) AS y, s.camera IS NOT NULL AS exact
    FROM sampled s FULL JOIN near n ON s.camera = n.camera AND s.name = n.name AND s.t = n.t""")
def observe_lerp_else_nearest(spark, sf):
    d = alignment.observed(cells(spark, sf), cameras(spark))
    return d.select("camera", "name", "t", r6("x"), r6("y"), "exact")


@query(with_(CELLS) + "SELECT name, count(DISTINCT camera) AS cameras FROM cells GROUP BY name HAVING count(DISTINCT camera) >= 2")
def common_names_k2(spark, sf):
    return alignment.common_names(cells(spark, sf), 2)


@query(with_(CELLS, CAMERA, _SAMPLED) + "SELECT name, t, count(*) AS cameras FROM sampled GROUP BY name, t HAVING count(*) >= 2")
def shared_instants(spark, sf):
    return alignment.shared_instants(_sampled(spark, sf), 2)


@query(with_(CELLS, CAMERA, _SAMPLED) + ", b AS (SELECT camera, t FROM sampled WHERE name IN ('lm1', 'lm2') GROUP BY camera, t HAVING count(DISTINCT name) = 2) SELECT camera, t, count(*) OVER (PARTITION BY t) AS cameras FROM b")
def pairs_both_seen(spark, sf):
    return alignment.pairs_seen(_sampled(spark, sf), "lm1", "lm2")


@query(with_(CELLS, CAMERA, _SAMPLED) + ", s AS (SELECT name, t FROM sampled WHERE name IN ('lm0', 'lm1', 'lm2') GROUP BY name, t HAVING count(*) >= 2) SELECT min(t) AS t FROM (SELECT t FROM s GROUP BY t HAVING count(*) = 3)")
def best_common_instant(spark, sf):
    return alignment.best_common_instant(_sampled(spark, sf), ["lm0", "lm1", "lm2"], 2)


@query(with_(CELLS) + ", p AS (SELECT camera, frame, count(DISTINCT name) AS k FROM cells WHERE name IN ('lm1', 'lm2') GROUP BY camera, frame) SELECT camera, count(*) FILTER (k = 2) AS \"both\", count(*) AS either FROM p GROUP BY camera")
def coverage_summary(spark, sf):
    return alignment.coverage(cells(spark, sf), "lm1", "lm2")


_SPANS = "spans AS (SELECT camera, (min(frame) - any_value(off)) / any_value(rate) AS lo, (max(frame) - any_value(off)) / any_value(rate) AS hi FROM cells JOIN camera USING (camera) GROUP BY camera)"


@query(with_(CELLS, CAMERA, _SPANS) + """, e AS (SELECT lo AS t, 0 AS k, 1 AS d FROM spans UNION ALL SELECT hi, 1, -1 FROM spans),
    s AS (SELECT t, d, coalesce(sum(d) OVER (ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
    SELECT min(t) FILTER (b + d >= 2 AND b < 2) AS lo, max(t) FILTER (b >= 2 AND b + d < 2) AS hi FROM s""")
def reference_span_k2(spark, sf):
    return alignment.covered_span(alignment.spans(cells(spark, sf), cameras(spark)), 2)


@query(with_(CELLS, CAMERA, _SPANS) + "SELECT max(lo) AS shared_lo, min(hi) AS shared_hi, min(lo) AS any_lo, max(hi) AS any_hi FROM spans")
def reference_windows(spark, sf):
    return alignment.windows(alignment.spans(cells(spark, sf), cameras(spark)))


@query(with_(CELLS) + ", h AS (SELECT DISTINCT camera, name FROM cells) SELECT c.camera, n.name FROM (SELECT DISTINCT camera FROM h) c CROSS JOIN (SELECT DISTINCT name FROM h) n ANTI JOIN h USING (camera, name)")
def missing_landmarks(spark, sf):
    return alignment.missing_names(cells(spark, sf))


_LAGS = """a AS (SELECT frame, c AS v FROM clean WHERE source = 'click'), b AS (SELECT frame, c AS v FROM clean WHERE source = 'view'),
    lags AS (SELECT unnest(range(-20, 21)) AS lag),
    sc AS (SELECT lag, count(*) AS n, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS r FROM lags JOIN a ON true JOIN b ON b.frame = a.frame + lag GROUP BY lag HAVING count(*) >= greatest(16, floor(0.1 * least((SELECT count(*) FROM a), (SELECT count(*) FROM b)))))"""


def _lag_scores(spark, sf):
    c = runs.detrended(_signals(spark, sf), "v").select("source", "frame", F.col("clean").alias("v"))
    return alignment.lag_scores(c.where("source = 'click'"), c.where("source = 'view'"), 20, 16)


@query(with_(CELLS, _SIGNAL, _CLEAN, _LAGS) + "SELECT lag, n, round(r, 4) AS r FROM sc")
def xcorr_lag(spark, sf):
    return _lag_scores(spark, sf).select("lag", "n", F.round("r", 4).alias("r"))


@query(with_(CELLS, _SIGNAL, _CLEAN, _LAGS) + """, best AS (SELECT lag, r FROM sc ORDER BY r DESC, lag LIMIT 1), m AS (SELECT b.lag, b.r, b.r - coalesce((SELECT max(r) FROM sc WHERE abs(sc.lag - b.lag) >= 3), 0) AS margin, (SELECT r FROM sc WHERE sc.lag = b.lag - 1) AS r0, (SELECT r FROM sc WHERE sc.lag = b.lag + 1) AS r1 FROM best b)
    SELECT lag, round(coalesce(CASE WHEN r0 + r1 < 2 * r THEN greatest(least((r0 - r1) / (2 * (r0 + r1 - 2 * r)), 0.5), -0.5) END, 0), 4) AS part, round(r, 4) AS r, round(margin, 4) AS margin, CASE WHEN r >= 0.45 AND margin >= 0.12 THEN 'clear' WHEN r >= 0.25 AND margin >= 0.05 THEN 'weak' ELSE 'none' END AS verdict FROM m""")
def lag_verdict(spark, sf):
    v = alignment.lag_verdict(_lag_scores(spark, sf))
    return v.select("lag", F.round("part", 4).alias("part"), F.round("r", 4).alias("r"), F.round("margin", 4).alias("margin"), "verdict")


# ---- triangulation -----------------------------------------------------------------------------------------

_SUMS = """eq AS (SELECT o.*, u*l9-l1 AS a1, u*l10-l2 AS a2, u*l11-l3 AS a3, l4-u AS p, v*l9-l5 AS b1, v*l10-l6 AS b2, v*l11-l7 AS b3, l8-v AS q FROM observed o JOIN dlt USING (cam)),
    s AS (SELECT name, frame, count(*) AS n, sum(a1*a1+b1*b1) AS m11, sum(a1*a2+b1*b2) AS m12, sum(a1*a3+b1*b3) AS m13, sum(a2*a2+b2*b2) AS m22, sum(a2*a3+b2*b3) AS m23, sum(a3*a3+b3*b3) AS m33,
            sum(a1*p+b1*q) AS r1, sum(a2*p+b2*q) AS r2, sum(a3*p+b3*q) AS r3 FROM eq GROUP BY name, frame),
    d AS (SELECT *, m11*(m22*m33-m23*m23) - m12*(m12*m33-m23*m13) + m13*(m12*m23-m22*m13) AS det FROM s),
    pt AS (SELECT name, frame, n, CASE WHEN n >= 2 THEN (r1*(m22*m33-m23*m23) - m12*(r2*m33-m23*r3) + m13*(r2*m23-m22*r3)) / det END AS x,
            CASE WHEN n >= 2 THEN (m11*(r2*m33-m23*r3) - r1*(m12*m33-m23*m13) + m13*(m12*r3-r2*m13)) / det END AS y,
            CASE WHEN n >= 2 THEN (m11*(m22*r3-r2*m23) - m12*(m12*r3-r2*m13) + r1*(m12*m23-m22*m13)) / det END AS z FROM d),
    err AS (SELECT name, frame, sum(pow((l1*x+l2*y+l3*z+l4)/(l9*x+l10*y+l11*z+1) - u, 2) + pow((l5*x+l6*y+l7*z+l8)/(l9*x+l10*y+l11*z+1) - v, 2)) AS e FROM observed o JOIN dlt USING (cam) JOIN pt USING (name, frame) GROUP BY name, frame),
    point AS (SELECT name, frame, x, y, z, sqrt(e / greatest(2*n-3, 1)) AS residual, CAST(CASE WHEN x IS NULL THEN 0 ELSE n END AS INTEGER) AS n_cams FROM pt JOIN err USING (name, frame))"""
_POINTS = "SELECT name, frame, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(residual, 6) AS residual, n_cams{} FROM point"


def _rounded(points: DataFrame, *more: str) -> DataFrame:
    return points.select("name", "frame", *(r6(c) for c in ("x", "y", "z", "residual")), "n_cams", *more)


def _points(spark, sf):
    return triangulation.triangulate(observations(spark, sf), calibration(spark))


@query(with_(OBSERVED, DLT_SQL, _SUMS) + _POINTS.format(", CASE WHEN residual IS NULL THEN '' WHEN residual <= 1.5 AND n_cams > 2 THEN 'good' WHEN residual <= 5.0 THEN 'ok' ELSE 'poor' END AS verdict"))
def triangulate(spark, sf):
    return _rounded(triangulation.with_verdict(_points(spark, sf), 1280, 720), "verdict")


@query(with_(OBSERVED, DLT_SQL, _SUMS) + "SELECT name, count(*) AS n, round(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END), 6) AS solved, round(median(residual), 6) AS median_residual, round(avg(CASE WHEN x IS NOT NULL THEN CASE WHEN n_cams = 2 THEN 1.0 ELSE 0.0 END END), 6) AS two_cameras FROM point GROUP BY GROUPING SETS ((), (name))")
def reconstruction_report(spark, sf):
    return triangulation.report(_points(spark, sf)).select("name", "n", r6("solved"), r6("median_residual"), r6("two_cameras"))


@query(with_(OBSERVED, DLT_SQL, _SUMS) + """, m AS (SELECT name, median(residual) AS r FROM point WHERE residual IS NOT NULL GROUP BY name)
    SELECT CASE WHEN count(residual) = 0 THEN 'empty' WHEN median(residual) <= 1.5 AND avg(CASE WHEN n_cams <= 2 THEN 1 ELSE 0 END) FILTER (residual IS NOT NULL) < 0.9 THEN 'good' WHEN median(residual) <= 5 THEN 'ok' ELSE 'poor' END AS verdict, round(median(residual), 6) AS median_residual,
        (SELECT name FROM m ORDER BY r DESC, name LIMIT 1) AS worst, (SELECT round(max(r), 6) FROM m) AS worst_residual, avg(CASE WHEN n_cams <= 2 THEN 1 ELSE 0 END) FILTER (residual IS NOT NULL) >= 0.9 AS capped FROM point""")
def reconstruction_verdict(spark, sf):
    v = triangulation.report_verdict(triangulation.report(_points(spark, sf)), 4, 1280, 720)
    return v.select("verdict", r6("median_residual"), "worst", r6("worst_residual"), "capped")


@query(with_(OBSERVED, DLT_SQL, _SUMS) + _POINTS.format(""))
def incremental_equals_full(spark, sf):
    """Old points of which a span was lost, brought up to date: the result is that of the full computation."""
    full = _points(spark, sf)
    stale = full.withColumn("x", F.when(F.col("frame") < 100, None).otherwise(F.col("x")))
    changed = full.select("name").distinct().select("name", F.lit(0).cast("long").alias("lo"), F.lit(99).cast("long").alias("hi"))
    fresh = triangulation.updated(stale, changed, observations(spark, sf), calibration(spark))
    return _rounded(fresh)


_LOO = """pair AS (SELECT o.name, o.frame, o.cam AS out, o.u AS ou, o.v AS ov, e.* EXCLUDE (name, frame) FROM observed o JOIN eq e ON e.name = o.name AND e.frame = o.frame AND e.cam <> o.cam),
    ls AS (SELECT name, frame, out, any_value(ou) AS ou, any_value(ov) AS ov, count(*) AS n, sum(a1*a1+b1*b1) AS m11, sum(a1*a2+b1*b2) AS m12, sum(a1*a3+b1*b3) AS m13, sum(a2*a2+b2*b2) AS m22, sum(a2*a3+b2*b3) AS m23, sum(a3*a3+b3*b3) AS m33,
            sum(a1*p+b1*q) AS r1, sum(a2*p+b2*q) AS r2, sum(a3*p+b3*q) AS r3 FROM pair GROUP BY name, frame, out HAVING count(*) >= 2),
    ld AS (SELECT *, m11*(m22*m33-m23*m23) - m12*(m12*m33-m23*m13) + m13*(m12*m23-m22*m13) AS det FROM ls),
    lp AS (SELECT name, frame, out, ou, ov, n, (r1*(m22*m33-m23*m23) - m12*(r2*m33-m23*r3) + m13*(r2*m23-m22*r3)) / det AS x,
            (m11*(r2*m33-m23*r3) - r1*(m12*m33-m23*m13) + m13*(m12*r3-r2*m13)) / det AS y, (m11*(m22*r3-r2*m23) - m12*(m12*r3-r2*m13) + r1*(m12*m23-m22*m13)) / det AS z FROM ld),
    le AS (SELECT name, frame, out, sqrt(sum(pow((l1*x+l2*y+l3*z+l4)/(l9*x+l10*y+l11*z+1) - u, 2) + pow((l5*x+l6*y+l7*z+l8)/(l9*x+l10*y+l11*z+1) - v, 2)) / greatest(2*any_value(lp.n)-3, 1)) AS rest
        FROM lp JOIN observed o USING (name, frame) JOIN dlt ON dlt.cam = o.cam WHERE o.cam <> lp.out GROUP BY name, frame, out),
    loo AS (SELECT name, frame, out AS cam, rest, sqrt(pow((l1*x+l2*y+l3*z+l4)/(l9*x+l10*y+l11*z+1) - ou, 2) + pow((l5*x+l6*y+l7*z+l8)/(l9*x+l10*y+l11*z+1) - ov, 2)) AS error FROM lp JOIN le USING (name, frame, out) JOIN dlt ON dlt.cam = lp.out)"""


def _loo(spark, sf):
    return triangulation.leave_one_out(observations(spark, sf), calibration(spark))


@query(with_(OBSERVED, DLT_SQL, _SUMS, _LOO) + "SELECT name, frame, CAST(cam AS INTEGER) AS cam, round(rest, 4) AS rest_residual, round(error, 4) AS error FROM loo")
def leave_one_out(spark, sf):
    return _loo(spark, sf).select("name", "frame", "cam", F.round("rest_residual", 4).alias("rest_residual"), F.round("error", 4).alias("error"))


@query(with_(OBSERVED, DLT_SQL, _SUMS, _LOO) + """, k AS (SELECT name, frame, cam, rest, lead(rest) OVER w AS nxt, row_number() OVER w AS rn FROM loo WINDOW w AS (PARTITION BY name, frame ORDER BY rest, cam))
    SELECT name, frame, CAST(cam AS INTEGER) AS cam, round(rest, 4) AS rest_residual FROM k JOIN point USING (name, frame) WHERE rn = 1 AND rest <= 5 AND rest <= 0.5 * residual AND nxt >= 1.5 * rest""")
def blame_camera(spark, sf):
    return triangulation.blame(_loo(spark, sf), _points(spark, sf), 5.0).select("name", "frame", "cam", F.round("rest_residual", 4).alias("rest_residual"))


@query(with_(OBSERVED, DLT_SQL, _SUMS, _LOO, _gap_sql("(SELECT * FROM loo WHERE error > 0.4)", "cam, name", 20, 3)) + 'SELECT CAST(cam AS INTEGER) AS cam, name, "start", "end", n FROM joined')
def disagreeing_stretches(spark, sf):
    return triangulation.disagreeing(_loo(spark, sf), 0.4, 3, 20)


@query(with_(OBSERVED, DLT_SQL) + """, r AS (SELECT name, frame, cam, (u*l10-l2) AS dummy, (l2-u*l10)*(l7-v*l11) - (l3-u*l11)*(l6-v*l10) AS x, (l3-u*l11)*(l5-v*l9) - (l1-u*l9)*(l7-v*l11) AS y, (l1-u*l9)*(l6-v*l10) - (l2-u*l10)*(l5-v*l9) AS z FROM observed JOIN dlt USING (cam))
    SELECT name, frame, CAST(cam AS INTEGER) AS cam, round(x / sqrt(x*x+y*y+z*z), 6) AS x, round(y / sqrt(x*x+y*y+z*z), 6) AS y, round(z / sqrt(x*x+y*y+z*z), 6) AS z FROM r""")
def camera_rays(spark, sf):
    d = observations(spark, sf).join(F.broadcast(calibration(spark)), "cam")
    ray = S.dlt_ray([F.get("coefs", F.lit(i)) for i in range(11)], F.col("u"), F.col("v"))
    return d.select("name", "frame", "cam", *(r6(c, k) for c, k in zip(ray, "xyz", strict=True)))


# ---- edits ---------------------------------------------------------------------------------------------------

_CELL = "camera, name, frame, x, y, confidence, visible, hand_placed, hidden"


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(c.strip() for c in _CELL.split(",")))


def _fresh(c: DataFrame) -> DataFrame:
    return c.where("frame between 50 and 199 and name in ('lm1', 'lm2')").select("camera", "name", "frame", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), F.lit(0.5).alias("confidence"))


@query(with_(CELLS) + f""", f AS (SELECT camera, name, frame, x + 1 AS x, y + 1 AS y FROM cells WHERE frame BETWEEN 50 AND 199 AND name IN ('lm1', 'lm2')),
    j AS (SELECT c.*, f.camera IS NOT NULL AND NOT hand_placed AS w, f.x AS nx, f.y AS ny, f.x >= -0.5 AND f.x < {WIDTH} - 0.5 AND f.y >= -0.5 AND f.y < {HEIGHT} - 0.5 AS ok FROM cells c LEFT JOIN f ON f.camera = c.camera AND f.name = c.name AND f.frame = c.frame)
    SELECT camera, name, frame, CASE WHEN w THEN CASE WHEN ok THEN nx END ELSE x END AS x, CASE WHEN w THEN CASE WHEN ok THEN ny END ELSE y END AS y, CASE WHEN w THEN CASE WHEN ok THEN 0.5 ELSE 0 END ELSE confidence END AS confidence, visible, hand_placed, hidden FROM j""")
def upsert_keep_hand(spark, sf):
    c = _plain(cells(spark, sf))
    return edits.upserted(c, _fresh(c), WIDTH, HEIGHT)


@query(with_(CELLS) + f"SELECT {_CELL} FROM cells WHERE NOT (name = 'lm1' AND frame BETWEEN 50 AND 199) OR hand_placed")
def clear_window(spark, sf):
    return edits.cleared(_plain(cells(spark, sf)), ["lm1"], 50, 199)


@query(with_(CELLS) + f"SELECT {_CELL.replace('name', 'CASE WHEN frame BETWEEN 50 AND 199 AND name = ' + chr(39) + 'lm1' + chr(39) + ' THEN ' + chr(39) + 'lm2' + chr(39) + ' WHEN frame BETWEEN 50 AND 199 AND name = ' + chr(39) + 'lm2' + chr(39) + ' THEN ' + chr(39) + 'lm1' + chr(39) + ' ELSE name END AS name', 1)} FROM cells")
def swap_landmarks(spark, sf):
    return edits.swapped(_plain(cells(spark, sf)), "lm1", "lm2", 50, 199)


_TAKEN = "src AS (SELECT * FROM cells WHERE name = 'lm1' AND frame BETWEEN 50 AND 199)"


@query(with_(CELLS, _TAKEN) + f"""SELECT {_CELL} FROM cells c WHERE NOT (name = 'lm1' AND frame BETWEEN 50 AND 199) AND NOT (name = 'lm2' AND EXISTS (SELECT 1 FROM src s WHERE s.camera = c.camera AND s.frame = c.frame))
    UNION ALL SELECT camera, 'lm2', frame, x, y, confidence, visible, hand_placed, hidden FROM src""")
def move_landmark(spark, sf):
    return edits.moved(_plain(cells(spark, sf)), "lm1", "lm2", 50, 199)


@query(with_(CELLS, _TAKEN) + f"""SELECT {_CELL} FROM cells UNION ALL SELECT camera, 'lm2', frame, x, y, confidence, visible, hand_placed, hidden FROM src s
    WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.name = 'lm2' AND c.camera = s.camera AND c.frame = s.frame)""")
def fill_gaps(spark, sf):
    return edits.gaps_filled(_plain(cells(spark, sf)), "lm1", "lm2", 50, 199)


@query(with_(CELLS) + "SELECT camera, CASE WHEN name = 'lm3' AND frame >= 120 THEN 'lm3 b' ELSE name END AS name, frame, x, y, confidence, visible, hand_placed, hidden FROM cells")
def split_landmark(spark, sf):
    return edits.split(_plain(cells(spark, sf)), "lm3", 120, "lm3 b")


@query(with_(CELLS) + "SELECT camera, name, frame, x, y, confidence, visible, hand_placed, CASE WHEN name = 'lm4' AND frame BETWEEN 10 AND 60 THEN true ELSE hidden END AS hidden FROM cells")
def hide_window(spark, sf):
    return edits.hidden(_plain(cells(spark, sf)), ["lm4"], 10, 60)


@query(with_(CELLS) + f"SELECT {_CELL} FROM cells")
def restore_from_snapshot(spark, sf):
    c = _plain(cells(spark, sf))
    return edits.restored(edits.cleared(c, ["lm1", "lm5"], 50, 199, keep_hand=False), c, ["lm1", "lm5"], 50, 199)


@query(with_(CELLS) + "SELECT camera, CASE WHEN name = 'lm6' THEN 'lm5 (2)' ELSE name END AS name, frame FROM cells")
def rename_with_clash(spark, sf):
    return edits.renamed(_plain(cells(spark, sf)), "lm6", "lm5").select("camera", "name", "frame")


@query(with_(CELLS) + """, w AS (SELECT camera, name, frame, x + k AS x, k AS win FROM cells, (SELECT unnest(range(0, 3)) AS k) WHERE frame // 8 - k >= 0)
    SELECT camera, name, frame, arg_max(x, win) AS x FROM w GROUP BY camera, name, frame""")
def overlap_last_write_wins(spark, sf):
    """Sixteen-frame windows every eight frames: the later window's estimate counts."""
    c = cells(spark, sf).select("camera", "name", "frame", "x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window"))
    return edits.last_write_wins(c.where(F.floor(F.col("frame") / 8) - F.col("window") >= 0).withColumn("x", F.col("x") + F.col("window")))


@query("WITH b AS (SELECT * FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)) SELECT s.s_suppkey AS camera, round(s.s_acctbal - (1 + s.s_nationkey / 25.0) / (1 + b.s_nationkey / 25.0) * b.s_acctbal, 6) AS \"offset\", round((1 + s.s_nationkey / 25.0) / (1 + b.s_nationkey / 25.0), 6) AS rate FROM supplier s, b")
def rebase_clock(spark, sf):
    """The clocks of a rig, a camera for each supplier, once the first one is the reference."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("camera"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("offset"), (1 + F.col("s_nationkey") / 25.0).alias("rate"))
    return edits.rebased(s).select("camera", r6("offset"), r6("rate"))


# ---- forms and ranks -------------------------------------------------------------------------------------------

_NAMES = [f"lm{i}" for i in range(8)]


@query(with_(CELLS) + "SELECT camera, frame, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN {v} END) AS {n}_{v}" for n in _NAMES for v in ("x", "y")) + " FROM cells GROUP BY camera, frame")
def pivot_wide(spark, sf):
    return reshape.wide(cells(spark, sf), _NAMES)


@query(with_(CELLS) + "SELECT camera, frame, name, x, y FROM cells")
def unpivot_long(spark, sf):
    return reshape.long(reshape.wide(cells(spark, sf), _NAMES), _NAMES)


@query(with_(CELLS) + "SELECT camera, frame, name, event_id FROM (SELECT *, rank() OVER (PARTITION BY camera, frame ORDER BY CASE WHEN hand_placed THEN 0 ELSE 1 END, CASE WHEN hand_placed THEN 0 ELSE -confidence END) AS r FROM cells) WHERE r = 1")
def best_instances(spark, sf):
    d = cells(spark, sf).withColumn("score", F.when(~F.col("hand_placed"), F.col("confidence")))
    return reshape.best_instances(d, ("camera", "frame")).select("camera", "frame", "name", "event_id")


@query(with_(CELLS) + "SELECT camera, frame, count(*) AS n, round(avg(confidence), 6) AS score FROM cells WHERE NOT hidden GROUP BY camera, frame")
def instance_scores(spark, sf):
    return reshape.instance_scores(cells(spark, sf)).select("camera", "frame", "n", r6("score"))


@query(with_(CELLS) + f""", v AS (SELECT camera, frame, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM cells GROUP BY camera, frame),
    q AS (SELECT camera, frame, round(n + 10 * (sx / {WIDTH}.0 + sy / {HEIGHT}.0) / 2, 6) AS quality FROM v)
    SELECT camera, frame, quality FROM q QUALIFY row_number() OVER (PARTITION BY camera ORDER BY quality DESC, frame) <= 10""")
def best_views(spark, sf):
    v = cells(spark, sf).groupBy("camera", "frame").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return reshape.best_views(v, 10, float(WIDTH), float(HEIGHT)).select("camera", "frame", r6("quality"))


# ---- angles and hulls --------------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(with_(_E) + """, t AS (SELECT vec_id, label, e[1]-e[4] AS u1, e[2]-e[5] AS u2, e[3]-e[6] AS u3, e[7]-e[4] AS v1, e[8]-e[5] AS v2, e[9]-e[6] AS v3 FROM e)
    SELECT vec_id, round(degrees(acos(greatest(-1, least(1, (u1*v1+u2*v2+u3*v3) / (sqrt(u1*u1+u2*u2+u3*u3) * sqrt(v1*v1+v2*v2+v3*v3)))))), 4) AS angle FROM t""")
def joint_angle_interior(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = [[F.get("e", F.lit(3 * k + i)) for i in range(3)] for k in range(3)]
    return e.select("vec_id", F.round(S.interior_angle(*p), 4).alias("angle"))


@query(with_(_E) + ", a AS (SELECT vec_id, 720 * e[1] AS v FROM e) SELECT vec_id, round(CASE WHEN v > -90 AND v <= 270 THEN v ELSE 270 - ((270 - v) - 360 * floor((270 - v) / 360)) END, 6) AS folded FROM a")
def fold_window(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", (720 * F.get(F.col("embedding").cast("array<double>"), F.lit(0))).alias("v"))
    return e.select("vec_id", r6(S.fold(F.col("v"), -90.0, 270.0), "folded"))


@query(with_(CELLS) + "SELECT camera, name, min(y) AS lo, max(y) AS hi, max(y) - min(y) AS span, median(y) AS median FROM cells GROUP BY camera, name")
def range_of_motion(spark, sf):
    from motionframe.operators.angles import range_of_motion as rom

    return rom(cells(spark, sf).select("camera", F.col("name").alias("angle"), F.col("y").alias("degrees")), ("camera",)).withColumnRenamed("angle", "name")


_VOTES = """grid AS (SELECT ix, iy, iz, -0.6 + (ix + 0.5) * 0.1 AS x, -0.6 + (iy + 0.5) * 0.1 AS y, -0.6 + (iz + 0.5) * 0.1 AS z FROM (SELECT unnest(range(0, 12)) AS ix), (SELECT unnest(range(0, 12)) AS iy), (SELECT unnest(range(0, 12)) AS iz)),
    mask AS (SELECT cam, CAST(floor(avg(u) - 2 * stddev_pop(u)) AS INT) AS u0, CAST(floor(avg(u) + 2 * stddev_pop(u)) AS INT) AS u1, CAST(floor(avg(v) - 2 * stddev_pop(v)) AS INT) AS v0, CAST(floor(avg(v) + 2 * stddev_pop(v)) AS INT) AS v1 FROM observed GROUP BY cam),
    pix AS (SELECT g.*, u0, u1, v0, v1, floor((l1*x+l2*y+l3*z+l4)/(l9*x+l10*y+l11*z+1) + 0.5) AS pu, floor((l5*x+l6*y+l7*z+l8)/(l9*x+l10*y+l11*z+1) + 0.5) AS pv FROM grid g, dlt JOIN mask USING (cam)),
    vote AS (SELECT ix, iy, iz, x, y, z, count(*) FILTER (pu >= 0 AND pu < 1280 AND pv >= 0 AND pv < 720 AND pu BETWEEN u0 AND u1 AND pv BETWEEN v0 AND v1) AS inside, count(*) FILTER (pu >= 0 AND pu < 1280 AND pv >= 0 AND pv < 720) AS seen FROM pix GROUP BY ix, iy, iz, x, y, z)"""


def _votes(spark, sf):
    """Masks are boxes of two deviations around the observed pixels of each camera."""
    grid = hull.voxels(spark, (-0.6, -0.6, -0.6), (12, 12, 12), 0.1)
    end = lambda c, k: F.floor(F.avg(c) + k * F.stddev_pop(c)).cast("int").alias(f"{c}{int(k > 0)}")
    masks = observations(spark, sf).groupBy("cam").agg(*(end(c, k) for c in "uv" for k in (-2, 2)))
    return hull.votes(grid, calibration(spark), masks, 1280, 720)


@query(with_(OBSERVED, DLT_SQL, _VOTES) + "SELECT ix, iy, iz, inside, seen FROM vote WHERE inside >= 3 AND inside >= seen - 1 AND seen > 0")
def hull_votes(spark, sf):
    return hull.carved(_votes(spark, sf), 3, 1).select("ix", "iy", "iz", "inside", "seen")


@query(with_(OBSERVED, DLT_SQL, _VOTES) + """SELECT round(count(*) * 0.001, 6) AS volume, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean, round(avg(z), 6) AS z_mean, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max,
    round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(CASE WHEN seen < 3 THEN 1.0 ELSE 0.0 END), 6) AS thin FROM vote WHERE inside >= 3 AND inside >= seen - 1 AND seen > 0""")
def hull_measures(spark, sf):
    m = hull.measures(hull.carved(_votes(spark, sf), 3, 1), 0.1)
    return m.select(*(r6(c) for c in m.columns))


# ---- grouped and stateful operators (checked against brute force in tests) -------------------------------------------


@query(None)
def smooth_runs(spark, sf):
    from motionframe.operators.grouped import smoothed

    return smoothed(cells(spark, sf), 30.0, 6.0, ("x",)).select("camera", "name", "frame", r6("s_x"))


@query(None)
def spline_fill(spark, sf):
    from motionframe.operators.grouped import keyframes_interpolated

    return keyframes_interpolated(cells(spark, sf), WIDTH, HEIGHT)


@query(None)
def loss_machine(spark, sf):
    from motionframe.streaming.loss import loss_batch

    c = cells(spark, sf)
    inside = S.in_frame(F.col("x"), F.col("y"), F.lit(520), F.lit(HEIGHT))
    return loss_batch(c.select("camera", "name", "frame", "confidence", inside.alias("inside")))
