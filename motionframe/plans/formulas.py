"""Registered queries over names, limits, cameras, lenses, angles, single edits and file layouts, each with its oracle in DuckDB SQL."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.functions import scalars as S
from motionframe.operators import alignment, edits, hull, triangulation
from motionframe.plans.adapter import CAMERAS, CELLS, DLT, HEIGHT, calibration, cells, read, with_
from motionframe.plans.motion import query, r6
from motionframe.sources import tracks
from motionframe.sources.scratch import folder

NAMES = [f"lm{i}" for i in range(8)]
E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _at(i: int):
    return F.get("e", F.lit(i))


# ---- names ------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '=+' || p_name WHEN 1 THEN ' ' || p_name || ',' || p_brand WHEN 2 THEN '@- ' ELSE p_name END AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS a FROM part)
    SELECT p_partkey, coalesce(nullif(trim(replace(n, ',', '_')), ''), 'point') AS clean, coalesce(nullif(trim(regexp_replace(n, '^[\\s=+\\-@]+', '')), ''), 'point') AS safe, CASE WHEN a = '' THEN n ELSE a || ' ' || n END AS whole FROM n""")
def spreadsheet_names(spark, sf):
    k = F.col("p_partkey") % 4
    n = F.when(k == 0, F.concat(F.lit("=+"), "p_name")).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(","), "p_brand")).when(k == 2, "@- ").otherwise(F.col("p_name"))
    d = read(spark, sf, "part").select("p_partkey", n.alias("n"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("a"))
    return d.select("p_partkey", S.sanitize(F.col("n")).alias("clean"), S.formula_safe(F.col("n")).alias("safe"), S.qualified(F.col("a"), F.col("n")).alias("whole"))


@query("""SELECT p_partkey, 'cam' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || '_take' || lpad(CAST(p_size AS VARCHAR), 12, '0') || '.mp4' AS k FROM part""".replace("'.mp4'", "'.mp' || lpad('4', 12, '0')"))
def natural_keys(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.natural_key(F.concat(F.lit("Cam"), "p_partkey", F.lit("_Take"), "p_size", F.lit(".mp4"))).alias("k"))


@query("""WITH n AS (SELECT c_custkey, (['L-', 'R_ ', 'left  ', ' Mid--'])[1 + c_custkey % 4] || (['Shoulder', 'big toe-TIP', 'Small_Toe tip', 'knee'])[1 + c_custkey // 4 % 4] AS n FROM customer),
    p AS (SELECT c_custkey, regexp_replace(lower(trim(n)), '[ _\\-]+', '_', 'g') AS p FROM n), s AS (SELECT c_custkey, CASE WHEN p LIKE 'l\\_%' ESCAPE '\\' THEN 'left_' || substr(p, 3) WHEN p LIKE 'r\\_%' ESCAPE '\\' THEN 'right_' || substr(p, 3) ELSE p END AS s FROM p)
    SELECT c_custkey, CASE WHEN regexp_matches(s, '^(left|right)_(big|small)_toe_tip$') THEN left(s, length(s) - 4) ELSE s END AS joint FROM s""")
def joint_names(spark, sf):
    i = F.col("c_custkey")
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    n = F.concat(pick(["L-", "R_ ", "left  ", " Mid--"], i % 4), pick(["Shoulder", "big toe-TIP", "Small_Toe tip", "knee"], F.floor(i / 4) % 4))
    return read(spark, sf, "customer").select("c_custkey", S.canonical_joint(n).alias("joint"))


@query("""WITH n AS (SELECT s_suppkey, (['tip', 'centroid', 'midline:0.5', 'midline:1.5', 'ext:L', 'ext:XL', 'midline:', 'midline:1.0', ''])[1 + s_suppkey % 9] AS spec FROM supplier)
    SELECT s_suppkey, spec IN ('tip', 'centroid', 'midline:0.5', 'midline:1.0', 'ext:L') AS valid FROM n""")
def derived_specs(spark, sf):
    specs = F.array(*map(F.lit, ["tip", "centroid", "midline:0.5", "midline:1.5", "ext:L", "ext:XL", "midline:", "midline:1.0", ""]))
    return read(spark, sf, "supplier").select("s_suppkey", S.valid_spec(F.get(specs, (F.col("s_suppkey") % 9).cast("int"))).alias("valid"))


# ---- limits -----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(greatest(3.0, 0.005 * w), 6) AS edge, round(greatest(6.0, 1.5 * p_size, 0.002 * w), 6) AS drift, round(CAST((p_size + 0.5) * 0.25 - 0.5 AS DOUBLE), 6) AS small, round((p_size + 0.5) / 0.25 - 0.5, 6) AS large,
    round(sqrt((p_size - 3 + 1) * (p_size - 3 + 1) + (w - 7 + 1) * (w - 7 + 1)), 6) AS diagonal FROM (SELECT *, CAST(p_partkey % 4000 AS DOUBLE) AS w FROM part)""")
def picture_limits(spark, sf):
    w, d = (F.col("p_partkey") % 4000).cast("double"), F.col("p_size").cast("double")
    return read(spark, sf, "part").select(
        "p_partkey", r6(S.edge_tolerance(w), "edge"), r6(S.drift_limit(w, d), "drift"), r6(S.centre_scale(d, F.lit(0.25)), "small"), r6(S.centre_unscale(d, F.lit(0.25)), "large"), r6(S.box_diagonal(F.lit(3.0), F.lit(7.0), d, w), "diagonal")
    )


@query("""WITH f AS (SELECT p_partkey, p_partkey % 60 * 1.0 AS f, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 49.5 WHEN 2 THEN -1.0 ELSE 10.0 END AS c FROM part)
    SELECT p_partkey, round(CASE WHEN c IS NULL OR c <= 0 OR c >= 49 THEN 1 WHEN f >= 50 THEN 0 ELSE 1 / (1 + pow(tan(pi() * f / 100) / tan(pi() * c / 100), 4)) END, 6) AS kept,
    round(least(100 / pi() * atan(tan(pi() * least(f, 49.95) / 100) / pow(1 / 0.9 - 1, 0.25)), 45), 6) AS cutoff FROM f""")
def guarded_gains(spark, sf):
    k = F.col("p_partkey")
    c = F.when(k % 5 == 0, F.lit(None).cast("double")).when(k % 5 == 1, 49.5).when(k % 5 == 2, -1.0).otherwise(10.0)
    f, fps = (k % 60).cast("double"), F.lit(100.0)
    return read(spark, sf, "part").select("p_partkey", r6(S.kept_fraction(f, c, fps), "kept"), r6(S.cutoff_keeping(f, fps, 0.9), "cutoff"))


# ---- cameras and lenses -----------------------------------------------------------------------------------------


def _det(m: list[list[float | str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = [[f"({x})" for x in row] for row in m]
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _lit(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _front_sql(k: tuple[float, ...], cam: int) -> str:
    m = [[_lit(k[r + j]) for j in range(3)] for r in (0, 4, 8)]
    right = [_lit(-k[3]), _lit(-k[7]), "CAST(-1 AS DOUBLE)"]
    centre = [f"{_det([[right[i] if j == c else m[i][j] for j in range(3)] for i in range(3)])} / {_det(m)}" for c in range(3)]
    return f"""SELECT vec_id, {cam} AS cam, sign({_det(m)}) * ({_lit(k[8])} * e[1] + {_lit(k[9])} * e[2] + {_lit(k[10])} * e[3] + 1) > 0 AS front,
        round(sqrt(pow(e[1] - {centre[0]}, 2) + pow(e[2] - {centre[1]}, 2) + pow(e[3] - {centre[2]}, 2)), 5) AS distance FROM e"""


@query(with_(E) + " UNION ALL ".join(_front_sql(k, c) for c, k in enumerate(DLT)))
def points_in_front(spark, sf):
    """Which points lie in front of which camera, and how far from its centre."""
    k = [F.get("coefs", F.lit(i)) for i in range(11)]
    d = _vectors(spark, sf).join(F.broadcast(calibration(spark).where(S.calibrated(F.col("coefs")))))  # four cameras
    x = [_at(i) for i in range(3)]
    away = S.norm(S.minus(x, list(S.camera_centre(k))))
    return d.select("vec_id", "cam", S.in_front(k, *x, S.front_sign(k)).alias("front"), F.round(away, 5).alias("distance"))


def _brown_sql(x: str, y: str) -> tuple[str, str]:
    r2 = f"({x} * {x} + {y} * {y})"
    radial = f"(1 + {r2} * (0.1 + {r2} * (-0.05 + {r2} * 0.01)))"
    return f"{x} * {radial} + 2 * 0.002 * {x} * {y} - 0.001 * ({r2} + 2 * {x} * {x})", f"{y} * {radial} + 0.002 * ({r2} + 2 * {y} * {y}) - 2 * 0.001 * {x} * {y}"


def _inverse_sql(source: str, k: int) -> str:
    r2 = "(p * p + q * q)"
    radial = f"(1 + {r2} * (0.1 + {r2} * (-0.05 + {r2} * 0.01)))"
    return f"s{k} AS (SELECT vec_id, u, v, (u - 2 * 0.002 * p * q + 0.001 * ({r2} + 2 * p * p)) / {radial} AS p, (v - 0.002 * ({r2} + 2 * q * q) + 2 * 0.001 * p * q) / {radial} AS q FROM {source})"


@query(with_(E, "a AS (SELECT vec_id, e[1] * 0.5 AS x, e[2] * 0.5 AS y FROM e)", f"d AS (SELECT vec_id, {_brown_sql('x', 'y')[0]} AS u, {_brown_sql('x', 'y')[1]} AS v FROM a)", "s0 AS (SELECT vec_id, u, v, u AS p, v AS q FROM d)", *(_inverse_sql(f"s{k - 1}", k) for k in range(1, 6)))
       + "SELECT vec_id, round(u, 6) AS u, round(v, 6) AS v, round(p, 6) AS x, round(q, 6) AS y FROM s5")
def lens_models(spark, sf):
    """Distorted coordinates and five steps of the way back."""
    k = [F.lit(v) for v in (0.1, -0.05, 0.01, 0.002, -0.001)]
    u, v = S.brown_distort(_at(0) * 0.5, _at(1) * 0.5, *k)
    d = _vectors(spark, sf).select("vec_id", u.alias("u"), v.alias("v"))
    x, y = S.brown_undistort(F.col("u"), F.col("v"), *k, steps=5)
    # In one select, the rounded u and v would be what the fold reads.
    return d.withColumns({"x": x, "y": y}).select("vec_id", r6("u"), r6("v"), r6("x"), r6("y"))


@query(with_(E, "s AS (SELECT vec_id, e[9] AS px, e[10] AS py, e[2 * i + 1] AS ax, e[2 * i + 2] AS ay, e[2 * i + 3] - e[2 * i + 1] AS dx, e[2 * i + 4] - e[2 * i + 2] AS dy FROM e CROSS JOIN (SELECT unnest(range(0, 3)) AS i))",
             "t AS (SELECT *, greatest(0, least(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t FROM s)")
       + "SELECT vec_id, round(min(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2))), 6) AS d FROM t GROUP BY vec_id")
def polyline_distances(spark, sf):
    line = F.array(*(F.struct(_at(2 * i).alias("x"), _at(2 * i + 1).alias("y")) for i in range(4)))
    return _vectors(spark, sf).select("vec_id", r6(S.closest_on_polyline(line, _at(8), _at(9))["d"], "d"))


# ---- angles and frames ------------------------------------------------------------------------------------------


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(u, v)) + ")"


def _cross(u: list[str], v: list[str]) -> list[str]:
    return [f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


_U, _V, _T = ([f"e[{k + i}]" for i in range(3)] for k in (1, 4, 7))
_AXIS = [f"({t} / sqrt({_dot(_T, _T)}))" for t in _T]
_FLAT_U, _FLAT_V = ([f"({x} - {_dot(u, _AXIS)} * {a})" for x, a in zip(u, _AXIS)] for u in (_U, _V))


@query(with_(E) + f"SELECT vec_id, round(degrees(atan2({_dot(_cross(_V, _U), _T)}, {_dot(_V, _U)})), 5) AS signed, round(degrees(atan2({_dot(_cross(_FLAT_V, _FLAT_U), _AXIS)}, {_dot(_FLAT_V, _FLAT_U)})), 5) AS twist FROM e")
def signed_angles(spark, sf):
    u, v, t = ([_at(k + i) for i in range(3)] for k in (0, 3, 6))
    return _vectors(spark, sf).select("vec_id", F.round(S.signed_angle(v, u, t), 5).alias("signed"), F.round(S.twist(u, v, t), 5).alias("twist"))


@query(with_(E) + "SELECT vec_id, round(2 * (0.6 * (e[1] - 0.1) - 0.8 * (e[2] - 0.2)), 6) AS x, round(2 * (0.8 * (e[1] - 0.1) + 0.6 * (e[2] - 0.2)), 6) AS y, round(2 * (e[3] - 0.3), 6) AS z FROM e")
def points_reframed(spark, sf):
    d = _vectors(spark, sf).select("vec_id", *(_at(i).alias(c) for i, c in enumerate("xyz")))
    return triangulation.similarity(d, [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]], [0.1, 0.2, 0.3], 2.0).select("vec_id", r6("x"), r6("y"), r6("z"))


@query(with_(E) + "SELECT " + ", ".join(f"round(min(e[{i + 1}]) - 0.25 * (max(e[{i + 1}]) - min(e[{i + 1}])), 6) AS {c}0, round(max(e[{i + 1}]) + 0.25 * (max(e[{i + 1}]) - min(e[{i + 1}])), 6) AS {c}1" for i, c in enumerate("xyz")) + " FROM e")
def point_bounds(spark, sf):
    d = hull.bounds(_vectors(spark, sf).select(*(_at(i).alias(c) for i, c in enumerate("xyz"))), 0.25)
    return d.select(*(r6(c) for c in d.columns))


_FACES = "v AS (SELECT vec_id AS i, e[1] AS x, e[2] AS y, e[3] AS z FROM e), f AS (SELECT vec_id AS a, vec_id + 1 AS b, vec_id + 2 AS c FROM e WHERE vec_id % 3 = 0)"


def _mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf).select(F.col("vec_id").alias("i"), *(_at(i).alias(c) for i, c in enumerate("xyz")))
    i = F.col("vec_id")
    return v, _vectors(spark, sf).where(i % 3 == 0).select(i.alias("a"), (i + 1).alias("b"), (i + 2).alias("c"))


@query(with_(E, _FACES) + "SELECT round(sum(" + _det([[f"{k}.{c}" for c in "xyz"] for k in ("va", "vb", "vc")]) + ") / 6, 5) AS volume FROM f JOIN v va ON va.i = a JOIN v vb ON vb.i = b JOIN v vc ON vc.i = c")
def mesh_volumes(spark, sf):
    return hull.mesh_volume(*_mesh(spark, sf)).select(F.round("volume", 5).alias("volume"))


@query(with_(E, _FACES, "g AS (SELECT a AS i, b AS j FROM f UNION SELECT b, a FROM f UNION SELECT a, c FROM f UNION SELECT c, a FROM f UNION SELECT b, c FROM f UNION SELECT c, b FROM f)",
             "m AS (SELECT g.i, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM g JOIN v ON v.i = g.j GROUP BY g.i)")
       + "SELECT v.i, " + ", ".join(f"round(v.{c} + 0.5 * (coalesce(m.{c}, v.{c}) - v.{c}), 6) AS {c}" for c in "xyz") + " FROM v LEFT JOIN m USING (i)")
def mesh_smoothed(spark, sf):
    d = hull.smoothed_mesh(*_mesh(spark, sf), 1, 0.5)
    return d.select("i", r6("x"), r6("y"), r6("z"))


# ---- single edits -----------------------------------------------------------------------------------------------

_CELL = "camera, name, frame, x, y, confidence, visible, hand_placed, hidden"


@query(with_(CELLS) + f"SELECT {_CELL} FROM cells WHERE NOT (camera = 'click' AND name = 'lm1' AND frame = 7) UNION ALL SELECT 'click', 'lm1', 7, 1.5, 2.5, 1.0, true, true, false")
def cell_placed(spark, sf):
    return edits.placed(cells(spark, sf), "click", "lm1", 7, 1.5, 2.5).select(*_CELL.split(", "))


@query(with_(CELLS) + f"SELECT {_CELL} FROM cells WHERE name NOT IN ('lm1', 'lm5')")
def landmarks_removed(spark, sf):
    return edits.removed(cells(spark, sf), ["lm1", "lm5"]).select(*_CELL.split(", "))


@query("SELECT o_orderkey, least(greatest(least(a, b), 0), 299) AS start, least(greatest(greatest(a, b), 0), 299) AS \"end\" FROM (SELECT o_orderkey, o_orderkey % 400 - 50 AS a, o_custkey % 350 - 20 AS b FROM orders)")
def events_clamped(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 400 - 50).alias("start"), (F.col("o_custkey") % 350 - 20).alias("end"))
    return edits.events_clamped(d, 300)


@query(with_(CELLS) + """, a AS (SELECT frame, name AS person, min(x) AS v FROM cells WHERE camera = 'click' GROUP BY 1, 2), b AS (SELECT frame, name AS person, min(x) AS v FROM cells WHERE camera = 'view' GROUP BY 1, 2)
    SELECT frame, person, CASE WHEN b.frame IS NOT NULL THEN b.v ELSE a.v END AS v FROM a FULL JOIN b USING (frame, person)""".replace("CASE WHEN b.frame IS NOT NULL THEN b.v ELSE a.v END", "coalesce(b.v, a.v)"))
def pose_runs_merged(spark, sf):
    one = lambda c: cells(spark, sf).where(F.col("camera") == c).groupBy("frame", F.col("name").alias("person")).agg(F.min("x").alias("v"))
    return edits.pose_runs_merged(one("click"), one("view"))


@query(with_(CELLS) + """, s AS (SELECT camera, frame, min(x) AS v FROM cells GROUP BY camera, frame), t AS (SELECT unnest(range(-500, 1000)) AS t),
    p AS (SELECT t, 0.75 * t AS f, CAST(floor(0.75 * t) AS BIGINT) AS k FROM t)
    SELECT a.camera, t AS frame, round(CASE WHEN f = k THEN a.v ELSE a.v * (1 - (f - k)) + b.v * (f - k) END, 6) AS v FROM p JOIN s a ON a.frame = k LEFT JOIN s b ON b.camera = a.camera AND b.frame = k + 1 WHERE f = k OR b.v IS NOT NULL""")
def signal_resampled(spark, sf):
    s = cells(spark, sf).groupBy("camera", "frame").agg(F.min("x").alias("v"))
    return alignment.resampled(s, F.lit(0.75), ("camera",)).select("camera", "frame", r6("v"))


# ---- file layouts: tables are written in a layout and read again --------------------------------------------------


def _text_file(lines: DataFrame, spark: SparkSession) -> str:
    """Writes ordered lines as one file, as these layouts ask for; a file holds one camera's recording."""
    path = folder(spark, "files")
    lines.coalesce(1).write.text(path)
    return path


def _with_header(table: DataFrame, spark: SparkSession) -> DataFrame:
    """The lines of a sorted table after a line with its column names."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
    lines = table.select(F.monotonically_increasing_id().alias("ord"), F.concat_ws(",", *values).alias("value"))
    return spark.createDataFrame([(-1, ",".join(table.columns))], "ord long, value string").union(lines).orderBy("ord").select("value")


_FILES = [c for c, *_ in CAMERAS]


def _each_camera(one) -> DataFrame:
    """Union over the cameras (a handful), each with a file of its own."""
    parts = [one(c).withColumn("camera", F.lit(c)) for c in _FILES]
    return reduce(DataFrame.unionByName, parts)


@query(with_(CELLS) + "SELECT camera, name, frame, x, y, confidence FROM cells WHERE NOT hidden")
def dlc_round_trip(spark, sf):
    c = cells(spark, sf).persist()
    return _each_camera(lambda camera: tracks.read_dlc(spark, _text_file(tracks.dlc_lines(c, NAMES, camera), spark)))


@query(with_(CELLS) + "SELECT camera, 1 AS cam, name, frame, round(x, 6) AS x, round(y, 6) AS y FROM cells WHERE NOT hidden")
def dltdv_round_trip(spark, sf):
    c = cells(spark, sf).persist()

    def one(camera: str) -> DataFrame:
        path = _text_file(_with_header(tracks.dltdv_table(c, NAMES, camera, HEIGHT, 360, flip=False), spark), spark)
        if tracks.detect(spark, path) != "dltdv":
            raise ValueError("the layout isn't recognized")
        return tracks.read_dltdv(spark, path, dict(enumerate(NAMES, 1))).select("cam", "name", "frame", r6("x"), r6("y"))

    return _each_camera(one)


@query(with_(CELLS) + "SELECT camera, name, frame, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(confidence AS FLOAT) AS confidence, visible, hand_placed, hidden FROM cells")
def own_round_trip(spark, sf):
    path = folder(spark, "files")
    tracks.write_own(cells(spark, sf).select("camera", "name", "frame", "x", "y", "confidence", "visible", "hand_placed", "hidden"), path)
    return tracks.read_own(spark, path, ("camera", "name")).select("camera", "name", "frame", "x", "y", "confidence", "visible", "hand_placed", "hidden")


@query("SELECT 'e' || label AS name, vec_id AS frame, " + ", ".join(f"any_value(CAST(embedding[{i + 1}] AS DOUBLE)) AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings GROUP BY 1, 2")
def points3d_round_trip(spark, sf):
    e = read(spark, sf, "embeddings").select(F.concat(F.lit("e"), "label").alias("name"), F.col("vec_id").alias("frame"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    names = sorted(r["name"] for r in e.select("name").distinct().collect())  # landmarks, a handful
    path = _text_file(_with_header(tracks.points3d_table(e, names), spark), spark)
    return tracks.read_points3d(spark, path).select("name", "frame", "x", "y", "z")


@query("""WITH o AS (SELECT 's' || s_suppkey AS camera, s_acctbal AS o, 1 + s_nationkey / 10.0 AS r FROM supplier), b AS (SELECT o, r FROM o WHERE camera = 's' || (SELECT min(s_suppkey) FROM supplier))
    SELECT camera, round(o.o - o.r / b.r * b.o, 6) AS "offset", round(o.r / b.r, 6) AS rate FROM o CROSS JOIN b""")
def offsets_round_trip(spark, sf):
    s = read(spark, sf, "supplier")
    path, first = folder(spark, "files"), s.agg(F.min("s_suppkey")).first()[0]
    tracks.write_offsets(s.select(F.concat(F.lit("s"), "s_suppkey").alias("camera"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("offset"), (1 + F.col("s_nationkey") / 10.0).alias("rate")), path)
    return tracks.read_offsets(spark, path, f"s{first}").select("camera", r6("offset"), r6("rate"))


@query("WITH k(i, v) AS (VALUES " + ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(DLT[0])) + ") SELECT CAST(row_number() OVER (PARTITION BY i ORDER BY s_suppkey) - 1 AS INTEGER) AS cam, i, v * s_acctbal AS v FROM supplier, k")
def dlt_round_trip(spark, sf):
    """One column of coefficients for each supplier, its balance times those of a camera."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.posexplode(F.array(*(F.lit(v) * F.col("s_acctbal") for v in DLT[0]))).alias("i", "v"))
    lines = s.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "v"))), lambda x: x["v"].cast("string")), ",").alias("value")).orderBy("i").select("value")
    return tracks.read_dlt_csv(spark, _text_file(lines, spark)).select(F.col("cam").cast("int").alias("cam"), F.posexplode("coefs").alias("i", "v"))


# ---- several animals, events ---------------------------------------------------------------------------------------


def _animals(spark, sf):
    """Landmarks of even number are parts of two animals, the others stand alone."""
    i = F.substring("name", 3, 1).cast("int")
    return cells(spark, sf).select("camera", F.when(i < 4, "a").when(i < 6, "b").alias("animal"), F.when(i < 6, F.concat(F.lit("p"), i % 4)).otherwise(F.col("name")).alias("name"), "frame", "x", "y", "confidence", "hidden")


_ANIMAL_SQL = "a AS (SELECT camera, CASE WHEN i < 4 THEN 'a' WHEN i < 6 THEN 'b' END AS animal, CASE WHEN i < 6 THEN 'p' || (i % 4) ELSE name END AS name, frame, x, y, confidence FROM (SELECT *, CAST(substr(name, 3, 1) AS INT) AS i FROM cells WHERE NOT hidden))"


@query(with_(CELLS, _ANIMAL_SQL) + "SELECT * FROM a")
def dlc_multi_round_trip(spark, sf):
    c = _animals(spark, sf).persist()
    one = lambda camera: tracks.read_dlc_multi(spark, _text_file(tracks.dlc_multi_lines(c.where(F.col("camera") == camera), ["a", "b"], [f"p{k}" for k in range(4)], ["lm6", "lm7"]), spark))
    return _each_camera(one)


@query(with_(CELLS, _ANIMAL_SQL) + "SELECT camera, coalesce(animal, 'scene') AS track, frame AS frame_idx, round(avg(confidence), 4) AS score, " + ", ".join(f"round(max(x) FILTER (name = '{n}'), 3) AS {n}_x, round(max(y) FILTER (name = '{n}'), 3) AS {n}_y, round(max(confidence) FILTER (name = '{n}'), 4) AS {n}_score" for n in ("p0", "p3", "lm6")) + " FROM a WHERE name IN ('p0', 'p3', 'lm6') GROUP BY ALL")
def sleap_export(spark, sf):
    """Instances of each camera as they are exported, numbers parsed again."""
    c = _animals(spark, sf).persist()
    nodes = ["p0", "p3", "lm6"]
    number = lambda col, name: F.col(f"`{col}`").cast("double").alias(name)
    wide = _each_camera(lambda camera: tracks.sleap_table(c.where(F.col("camera") == camera), nodes))
    return wide.select("camera", "track", "frame_idx", number("instance.score", "score"), *(number(f"{n}.{v}", f"{n}_{v}") for n in nodes for v in ("x", "y", "score")))


@query("""SELECT p_name || ', "' || p_brand || '"' AS name, CAST(p_size AS BIGINT) AS "start", CAST(p_size + 5 AS BIGINT) AS "end", CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || chr(10) || 'second line' END AS note, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS author FROM part
    UNION ALL SELECT 'note', CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT), s_name, '' FROM supplier""")
def events_round_trip(spark, sf):
    p, path = read(spark, sf, "part"), folder(spark, "files")
    text = F.when(F.col("p_partkey") % 3 != 0, F.concat("p_type", F.lit("\nsecond line")))
    events = p.select(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 5).cast("long").alias("end"), text.alias("note"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).alias("author"))
    notes = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("frame"), F.col("s_name").alias("text"), F.lit(None).cast("string").alias("author"))
    tracks.write_events(events, notes, path)
    return tracks.read_events(spark, path)
