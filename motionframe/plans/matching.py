"""Registered queries over imports, verdicts and sound, each with its oracle in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.functions import scalars as S
from motionframe.operators import grouped, imports, sound, verdicts
from motionframe.plans.adapter import CELLS, HEIGHT, WIDTH, cells, read, with_
from motionframe.plans.motion import _signals, query, r6
from motionframe.plans.project import FRAMES

# ---- imports ------------------------------------------------------------------------------------------------

#: Names that a file gives the eight landmarks, and where each goes: a repeat, another case, a formula, a fixed one, new ones.
_FILE = (("lm0", "lm0", "updated"), ("lm0", "lm0 (2)", "new"), ("LM2", "LM2 (2)", "new"), ("=lm3", "lm3", "updated"), ("lm4", None, "skipped"), ("x,y", "x,y", "new"), ("lm6", "lm6", "updated"), ("lm5 (2)", "lm5 (2)", "new"))
_file_rows = ", ".join(f"('lm{i}', {i}, '{n}', {'NULL' if t is None else repr(t)}, '{o}')" for i, (n, t, o) in enumerate(_FILE))
FILE = f"""file(name, ord, named, target, outcome) AS (VALUES {_file_rows}),
    rows AS (SELECT camera, ord, named, target, outcome, frame + 10 AS frame, x, y, confidence, visible, hand_placed, hidden,
        CASE WHEN NOT (frame + 10 BETWEEN 0 AND {FRAMES - 1}) THEN 'beyond' WHEN x >= -0.5 AND x < {WIDTH} - 0.5 AND y >= -0.5 AND y < {HEIGHT} - 0.5 THEN 'kept' ELSE 'outside' END AS fate FROM cells JOIN file USING (name))"""


def _file(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for i, (n, _, _) in enumerate(_FILE) for x in (f"lm{i}", n)))
    d = cells(spark, sf).withColumns({"ord": F.substring("name", 3, 1).cast("int"), "row": F.col("frame"), "frame": F.col("frame") + 10, "y": HEIGHT - F.col("y")})
    return imports.placed(d.withColumn("name", names[F.col("name")]), WIDTH, HEIGHT, FRAMES, flip=True)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    landmarks = cells(spark, sf).select("camera", "name").distinct().withColumn("fixed", F.col("name") == "lm4")
    return imports.file_claims(_file(spark, sf), landmarks)


@query(with_(CELLS, FILE) + "SELECT DISTINCT camera, ord, target, outcome, ord = 1 AS repeated FROM rows WHERE fate = 'kept'")
def import_claims(spark, sf):
    return _claims(spark, sf).select("camera", "ord", "target", "outcome", "repeated")


@query(with_(CELLS, FILE) + """, fresh AS (SELECT camera, target AS name, frame, x, y, hand_placed FROM rows WHERE fate = 'kept' AND outcome <> 'skipped')
    SELECT * FROM fresh UNION ALL SELECT c.camera, c.name, c.frame, c.x, c.y, c.hand_placed FROM cells c ANTI JOIN fresh f ON f.camera = c.camera AND f.name = c.name AND f.frame = c.frame""")
def import_cells(spark, sf):
    return imports.imported(cells(spark, sf), _file(spark, sf), _claims(spark, sf)).select("camera", "name", "frame", "x", "y", "hand_placed")


@query(with_(CELLS, FILE) + """SELECT camera, count(*) FILTER (fate = 'kept' AND outcome <> 'skipped') AS cells, count(*) FILTER (fate = 'outside') AS outside, count(*) FILTER (fate = 'beyond') AS beyond,
    count(DISTINCT ord) FILTER (fate = 'kept' AND outcome = 'new') AS new, count(DISTINCT ord) FILTER (fate = 'kept' AND outcome = 'updated') AS updated,
    count(DISTINCT ord) FILTER (fate = 'kept' AND outcome = 'skipped') AS skipped, count(DISTINCT ord) FILTER (fate = 'kept' AND ord = 1) AS duplicates FROM rows GROUP BY camera""")
def import_counts(spark, sf):
    return imports.import_counts(_file(spark, sf), _claims(spark, sf))


# ---- verdicts -----------------------------------------------------------------------------------------------


@query(with_(CELLS) + """, c AS (SELECT camera, name, event_id % 13 + 1.0 AS b, CASE WHEN name <> 'lm3' OR event_id % 4 > 0 THEN (event_id % 13 + 1.0) * CASE WHEN name IN ('lm0', 'lm1') THEN 0.5 WHEN name = 'lm2' THEN 1.5 ELSE 1 END END AS a FROM cells),
    g AS (SELECT camera, name, count(*) AS n, count(*) FILTER (a IS NULL) AS lost, median(CASE WHEN a IS NOT NULL THEN b END) AS "before", median(a) AS "after" FROM c GROUP BY camera, name)
    SELECT camera, name, n, lost, round("before", 6) AS "before", round("after", 6) AS "after", CASE WHEN lost > 0 THEN 'worse' WHEN "before" IS NULL THEN 'same' WHEN "after" < 0.7 * "before" THEN 'better' WHEN "after" > 1.3 * "before" THEN 'worse' ELSE 'same' END AS verdict FROM g""")
def retrack_verdicts(spark, sf):
    c = cells(spark, sf).withColumn("error", F.col("event_id") % 13 + 1.0)
    by = F.when(F.col("name").isin("lm0", "lm1"), 0.5).when(F.col("name") == "lm2", 1.5).otherwise(1.0)
    after = c.where("name <> 'lm3' OR event_id % 4 > 0").withColumn("error", F.col("error") * by)
    d = verdicts.retrack_verdicts(c, after, ("camera", "name", "frame"), ("camera", "name"))
    return d.select("camera", "name", "n", "lost", r6("before"), r6("after"), "verdict")


@query("""WITH d AS (SELECT l_orderkey AS moment, l_linenumber - 3 AS shift, l_quantity / 200.0 AS distance FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY moment ORDER BY distance, abs(shift), shift) AS k FROM d),
    b AS (SELECT moment, max(shift) FILTER (k = 1) AS shift, CAST(max(distance) FILTER (k = 1) AS DOUBLE) AS b, CAST(max(distance) FILTER (k = 2) AS DOUBLE) AS nxt FROM r GROUP BY moment)
    SELECT moment, CAST(shift AS INTEGER) AS shift, CASE WHEN b > 0.2 THEN 'none' WHEN nxt IS NULL OR nxt - b < 0.004 THEN 'unclear' WHEN nxt >= 3.0 * b THEN 'clear' WHEN nxt >= 1.2 * b THEN 'lean' ELSE 'unclear' END AS verdict FROM b""")
def judged_shifts(spark, sf):
    d = read(spark, sf, "lineitem")
    d = d.select(F.col("l_orderkey").alias("moment"), (F.col("l_linenumber") - 3).cast("int").alias("shift"), (F.col("l_quantity").cast("double") / 200.0).alias("distance"))
    return verdicts.judged_shifts(d, ("moment",))


@query("""WITH s AS (SELECT label AS recording, vec_id * 0.125 AS t, CAST(embedding[1] AS DOUBLE) AS gx, CAST(embedding[2] AS DOUBLE) AS gy, 9.0 + CAST(embedding[3] AS DOUBLE) AS gz FROM embeddings),
    u AS (SELECT recording, min(t) AS t0, count(*) AS n, median(gx) AS mx, median(gy) AS my, median(gz) AS mz FROM s GROUP BY recording),
    m AS (SELECT recording, floor((t - t0) / 0.25) AS k, t0, mx, my, mz, avg(gx) AS gx, avg(gy) AS gy, avg(gz) AS gz FROM s JOIN u USING (recording) WHERE n >= 4 GROUP BY ALL),
    o AS (SELECT recording, k, t0, degrees(acos(greatest(least((gx*mx + gy*my + gz*mz) / (sqrt(gx*gx + gy*gy + gz*gz) * sqrt(mx*mx + my*my + mz*mz)), 1), -1))) AS off FROM m),
    g AS (SELECT *, count(*) FILTER (off <= 0.5) OVER (PARTITION BY recording ORDER BY k) AS g FROM o)
    SELECT recording, round(min(t0 + k * 0.25), 6) AS "start", round(max(t0 + (k + 1) * 0.25), 6) AS "end", round(max(off), 5) AS tilt FROM g WHERE off > 0.5 GROUP BY recording, g""")
def tilt_moves(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    d = read(spark, sf, "embeddings").select(F.col("label").alias("recording"), (F.col("vec_id") * 0.125).alias("t"), at(0).alias("gx"), at(1).alias("gy"), (9.0 + at(2)).alias("gz"))
    return verdicts.tilt_moves(d, "recording").select("recording", r6("start"), r6("end"), F.round("tilt", 5).alias("tilt"))


_RESULTS = """r AS (SELECT p_partkey AS ord, p_brand AS cue, CASE p_size % 3 WHEN 0 THEN 'spot' WHEN 1 THEN 'dense' ELSE 'sparse' END AS model, CAST(p_size % 4 AS BIGINT) AS corrections, CAST(p_size % 2 AS BIGINT) AS drifts,
    CASE WHEN p_partkey % 9 > 0 THEN CAST(p_retailprice AS DOUBLE) / 1000 END AS median_error, CASE WHEN p_partkey % 11 = 0 THEN 'lost' ELSE '' END AS error FROM part)"""


def _results(spark, sf):
    size = F.col("p_size")
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("cue"), F.when(size % 3 == 0, "spot").when(size % 3 == 1, "dense").otherwise("sparse").alias("model"), (size % 4).cast("long").alias("corrections"), (size % 2).cast("long").alias("drifts"),
        F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice").cast("double") / 1000).alias("median_error"), F.when(F.col("p_partkey") % 11 == 0, "lost").otherwise("").alias("error"),
    )


@query("WITH " + _RESULTS + """ SELECT cue, ord, corrections, drifts, round(median_error, 6) AS median_error FROM r QUALIFY row_number() OVER (PARTITION BY cue ORDER BY error <> '', CASE WHEN error <> '' THEN 1000000000 ELSE corrections END,
    CASE WHEN error <> '' THEN 1000000000 ELSE drifts END, CASE WHEN error = '' THEN coalesce(median_error, 'inf'::DOUBLE) ELSE 'inf'::DOUBLE END, ord) = 1""")
def best_settings(spark, sf):
    return verdicts.best_settings(_results(spark, sf)).select("cue", "ord", "corrections", "drifts", r6("median_error"))


@query("WITH " + _RESULTS + """ SELECT ord, model, corrections, drifts FROM r WHERE error = '' ORDER BY corrections, drifts, round_even(coalesce(median_error, 'inf'::DOUBLE), 1), CASE model WHEN 'dense' THEN 1 WHEN 'sparse' THEN 2 ELSE 3 END, ord LIMIT 1""")
def recommended_model(spark, sf):
    return verdicts.recommended(_results(spark, sf), ["dense", "sparse"]).select("ord", "model", "corrections", "drifts")


_CLIPS = """v AS (SELECT o_orderkey AS camera, CAST(o_orderkey - (SELECT min(o_orderkey) FROM orders) AS BIGINT) AS ord, CASE WHEN o_custkey % 5 > 0 THEN strftime(o_orderdate, '%Y%m%d') || '_' || CASE WHEN o_custkey % 7 > 0 THEN '101530' ELSE '256199' END END AS stamp, 24.0 + o_custkey % 6 AS fps FROM orders)"""


@query("WITH " + _CLIPS + """, s AS (SELECT *, CASE WHEN stamp NOT LIKE '%256199' THEN epoch(strptime(stamp, '%Y%m%d_%H%M%S')) END AS s FROM v)
    SELECT camera, CAST(-(s - (SELECT s FROM s WHERE ord = 0)) * fps AS DOUBLE) AS "offset" FROM s""")
def name_clock_offsets(spark, sf):
    o = read(spark, sf, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.when(F.col("o_custkey") % 7 > 0, "101530").otherwise("256199"))
    low = o.agg(F.min("o_orderkey")).scalar()
    name = F.concat(F.lit("D:\\clips/20990101_000000\\cam_"), F.when(F.col("o_custkey") % 5 > 0, stamp).otherwise("x"), F.lit("_a.mp4"))
    d = o.select(F.col("o_orderkey").alias("camera"), (F.col("o_orderkey") - low).alias("ord"), name.alias("path"), (24.0 + F.col("o_custkey") % 6).alias("fps"))
    return verdicts.name_clock_offsets(d).select("camera", "offset")


@query(with_(CELLS) + "SELECT camera, frame, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cells GROUP BY camera, frame")
def mask_boxes(spark, sf):
    return verdicts.mask_boxes(cells(spark, sf), ("camera", "frame"))


@query(with_(CELLS) + """SELECT name AS person, round(avg(confidence) FILTER (confidence > 0 AND event_id % 3 <> 1), 6) AS score, count(*) FILTER (confidence > 0 AND event_id % 3 <> 1) AS detected, count(*) FILTER (visible) AS posed FROM cells GROUP BY name""")
def person_scores(spark, sf):
    source = F.when(F.col("event_id") % 3 == 0, "detector").when(F.col("event_id") % 3 == 1, "silhouette")
    d = cells(spark, sf).select(F.col("name").alias("person"), F.when(F.col("confidence") > 0, F.col("confidence")).alias("score"), source.alias("source"), F.col("visible").alias("posed"))
    return verdicts.person_scores(d).select("person", r6("score"), "detected", "posed")


@query(with_(CELLS) + "SELECT camera, name, frame, round(greatest(least(confidence * 1.5 - 0.2, 1), 0) / (1 + exp(-(x / 20 - 2))), 6) AS confidence FROM cells")
def ball_confidences(spark, sf):
    c = verdicts.ball_confidence(F.col("confidence") * 1.5 - 0.2, F.col("x") / 20)
    return cells(spark, sf).select("camera", "name", "frame", r6(c, "confidence"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, e, sqrt(pow(e[3]-e[1], 2) + pow(e[4]-e[2], 2)) AS a, sqrt(pow(e[5]-e[3], 2) + pow(e[6]-e[4], 2)) AS b FROM e),
    p AS (SELECT vec_id, e, a, b, i, i * (a + b) / 4.0 AS w FROM s, (SELECT unnest(range(0, 5)) AS i))
    SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN w <= a THEN e[1] + (e[3]-e[1]) * w / a ELSE e[3] + (e[5]-e[3]) * (w-a) / b END, 6) AS x, round(CASE WHEN w <= a THEN e[2] + (e[4]-e[2]) * w / a ELSE e[4] + (e[6]-e[4]) * (w-a) / b END, 6) AS y FROM p""")
def paths_resampled(spark, sf):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    path = F.array(*(F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")) for i in range(3)))
    d = read(spark, sf, "embeddings").select("vec_id", F.posexplode(S.resampled_path(path, 5)).alias("i", "p"))
    return d.select("vec_id", "i", r6(F.col("p.x"), "x"), r6(F.col("p.y"), "y"))


# ---- sound --------------------------------------------------------------------------------------------------


def _sound(spark, sf):
    d = _signals(spark, sf).where("source IN ('click', 'view') AND frame >= 0")
    return d.select(F.lit("pair").alias("pair"), (F.col("source") == "view").alias("other"), F.col("frame").alias("i"), "v")


@query(None)
def sound_delays(spark, sf):
    return sound.delays(sound.correlogram(_sound(spark, sf), 20, 150), 100.0)


@query(None)
def rhythms(spark, sf):
    return grouped.rhythms(_signals(spark, sf), 100.0, "v", ("source",))
