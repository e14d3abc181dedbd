"""The engine's tables made from the shared test tables, in Spark and as DuckDB CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 200, 60

#: (camera, order, offset, rate)
CAMERAS = (("click", 0, 0.0, 1.0), ("error", 1, 0.5, 1.0), ("purchase", 2, -3.25, 1.0), ("signup", 3, 7.0, 2.0), ("view", 4, 0.25, 0.5))

#: Eleven linear coefficients of four fixed cameras.
DLT = (
    (-357.684794, 337.208232, -58.093797, 640.0, -34.686953, -10.729932, -448.71407, 360.0, -0.361322, -0.11177, -0.090772),
    (-321.368544, -323.915305, -94.369973, 640.0, -12.28033, 39.698969, -421.715818, 360.0, 0.099035, -0.320153, -0.147453),
    (283.02, -300.377187, -116.231555, 640.0, -93.256456, -28.847602, -377.525539, 360.0, 0.271094, 0.083859, -0.181612),
    (337.208232, 357.684794, -58.093797, 640.0, -10.729932, 34.686953, -448.71407, 360.0, -0.11177, 0.361322, -0.090772),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_cell``: one row for each camera, landmark and frame that has data; the first event wins."""
    e = read(spark, sf_dir, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    own = e.select(
        F.col("event_type").alias("camera"), F.concat(F.lit("lm"), F.col("user_id") % 8).alias("name"), F.floor(seconds / 7200).cast("long").alias("frame"),
        F.struct("event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y")).alias("c"),
    )
    one = own.groupBy("camera", "name", "frame").agg(F.min("c").alias("c"))
    i = F.col("c.event_id")
    return one.select(
        "camera", "name", "frame", "c.x", "c.y", i.alias("event_id"), ((i % 100) / 100.0).alias("confidence"),
        (i % 7 != 0).alias("visible"), (i % 5 == 0).alias("hand_placed"), (i % 11 == 0).alias("hidden"),
    )


CELLS = """cells AS (
    SELECT camera, name, frame, x, y, event_id, (event_id % 100) / 100.0 AS confidence, event_id % 7 <> 0 AS visible,
           event_id % 5 = 0 AS hand_placed, event_id % 11 = 0 AS hidden
    FROM (SELECT event_type AS camera, 'lm' || (user_id % 8) AS name,
                 CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 7200) AS BIGINT) AS frame, value AS x,
                 CAST(json_extract(props, '$.k') AS DOUBLE) AS y, event_id,
                 row_number() OVER (PARTITION BY event_type, user_id % 8, floor(epoch(ts - TIMESTAMP '2024-01-01') / 7200) ORDER BY event_id) AS rn
          FROM events) WHERE rn = 1)"""


def cameras(spark: SparkSession) -> DataFrame:
    """The camera dimension (a fixed handful of rows)."""
    rows = [(c, o, off, rate, WIDTH, HEIGHT) for c, o, off, rate in CAMERAS]
    return spark.createDataFrame(rows, "camera string, ord int, offset double, rate double, width int, height int")


_camera_rows = ", ".join(f"('{c}', {o}, CAST({off} AS DOUBLE), CAST({rate} AS DOUBLE), {WIDTH}, {HEIGHT})" for c, o, off, rate in CAMERAS)
CAMERA = f"camera(camera, ord, off, rate, width, height) AS (VALUES {_camera_rows})"


def calibration(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(DLT)], "cam int, coefs array<double>")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, frame, cam, u, v): pixels of known 3D points in the four fixed cameras, with small known errors."""
    from motionframe.functions.scalars import dlt_project

    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    at = lambda i: F.get("e", F.lit(i))
    rows = []
    for c, coefs in enumerate(DLT):
        u, v = dlt_project([F.lit(x) for x in coefs], at(0), at(1), at(2))
        seen = F.abs(at(11 + c)) <= 0.15
        rows.append(F.when(seen, F.struct(F.lit(c).alias("cam"), (u + 2 * at(3 + 2 * c)).alias("u"), (v + 2 * at(4 + 2 * c)).alias("v"))))
    own = e.select(F.concat(F.lit("e"), F.col("label")).alias("name"), F.col("vec_id").alias("frame"), F.array_compact(F.array(*rows)).alias("o"))
    return own.select("name", "frame", F.inline("o"))


def _seen(c: int) -> str:
    k = DLT[c]
    at = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
    w = f"(CAST({k[8]} AS DOUBLE)*{at(0)} + CAST({k[9]} AS DOUBLE)*{at(1)} + CAST({k[10]} AS DOUBLE)*{at(2)} + 1)"
    p = lambda a: f"(CAST({k[a]} AS DOUBLE)*{at(0)} + CAST({k[a + 1]} AS DOUBLE)*{at(1)} + CAST({k[a + 2]} AS DOUBLE)*{at(2)} + CAST({k[a + 3]} AS DOUBLE))/{w}"
    return f"SELECT 'e' || label AS name, vec_id AS frame, {c} AS cam, {p(0)} + 2*{at(3 + 2 * c)} AS u, {p(4)} + 2*{at(4 + 2 * c)} AS v FROM embeddings WHERE abs({at(11 + c)}) <= 0.15"


OBSERVED = "observed AS (" + " UNION ALL ".join(_seen(c) for c in range(len(DLT))) + ")"
_dlt_rows = ", ".join(f"({i}, " + ", ".join(f"CAST({x} AS DOUBLE)" for x in c) + ")" for i, c in enumerate(DLT))
DLT_SQL = "dlt(cam, " + ", ".join(f"l{i + 1}" for i in range(11)) + f") AS (VALUES {_dlt_rows})"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
