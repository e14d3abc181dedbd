"""Registered queries over project folders: what is saved, edited, saved again and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from motionframe.plans.adapter import CELLS, cells, with_
from motionframe.plans.motion import query
from motionframe.sources import project_folder, telemetry
from motionframe.sources.scratch import folder, written

_COLUMNS = ("camera", "name", "frame", "x", "y", "confidence", "visible", "hand_placed", "hidden")


def _saved_twice(spark, sf) -> str:
    """A project saved, then saved again with one landmark moved and another gone."""
    path = folder(spark, "project")
    c = cells(spark, sf).select(*_COLUMNS)
    project_folder.save(c, path)
    project_folder.save(c.where("name <> 'lm6'").withColumn("x", F.when(F.col("name") == "lm3", F.col("x") + 1).otherwise(F.col("x"))), path)
    return path


@query(with_(CELLS) + "SELECT camera, name, frame, CASE WHEN name = 'lm3' THEN x + 1 ELSE x END AS x, y, confidence, visible, hand_placed, hidden FROM cells WHERE name <> 'lm6'")
def project_saved_twice(spark, sf):
    return project_folder.load(spark, _saved_twice(spark, sf)).select(*_COLUMNS)


@query(with_(CELLS) + "SELECT camera, name, CASE WHEN name = 'lm3' THEN 2 ELSE 1 END AS version, count(*) AS rows FROM cells WHERE name <> 'lm6' GROUP BY camera, name")
def project_partitions(spark, sf):
    """Which save's files each partition keeps."""
    return project_folder.manifest(spark, _saved_twice(spark, sf)).select("camera", "name", "version", "rows")


@query(with_(CELLS) + "SELECT camera, name, frame, x, y, confidence, visible, hand_placed, hidden FROM cells")
def project_rolled_back(spark, sf):
    path = _saved_twice(spark, sf)
    project_folder.roll_back(spark, path, 1)
    return project_folder.load(spark, path).select(*_COLUMNS)


# ---- telemetry -----------------------------------------------------------------------------------------------

#: Frames of a recording; every seventh recording is cut off in its last stream.
BLOCK, CUT = 40, 7


@query(with_(CELLS) + f""", b AS (SELECT camera, name, frame, x, y, confidence, frame // {BLOCK} AS block, row_number() OVER (PARTITION BY camera, name, frame // {BLOCK} ORDER BY frame) - 1 AS sample FROM cells)
    SELECT camera || '/' || name || '/' || block AS path, 'GRAV' AS key, 'place' AS name, CAST(block AS DOUBLE) AS block_time, sample, round(x, 2) AS v0, round(y, 2) AS v1 FROM b
    UNION ALL SELECT camera || '/' || name || '/' || block, 'CONF', 'confidence', CAST(block AS DOUBLE), sample, round(confidence, 2), NULL FROM b WHERE block % {CUT} <> 3""")
def telemetry_round_trip(spark, sf):
    """Cells as recordings of two streams a block, stored as bytes and read again, some of them cut off."""
    c = cells(spark, sf).select(F.concat_ws("/", "camera", "name", F.floor(F.col("frame") / BLOCK).cast("string")).alias("path"), F.floor(F.col("frame") / BLOCK).cast("int").alias("block"), "frame", "x", "y", "confidence")

    def encode(f):
        f = f.sort_values("frame")
        block = int(f["block"].iloc[0])
        data = telemetry.device([("GRAV", "place", "l", (100, 100), f[["x", "y"]].to_numpy(), block), ("CONF", "confidence", "S", (100,), f[["confidence"]].to_numpy(), block)])
        return f[["path"]].head(1).assign(content=data[:-5] if block % CUT == 3 else data)

    stored = written(c.groupBy("path", "block").applyInPandas(encode, "path string, content binary"), "recordings")
    d = telemetry.telemetry(stored)
    return d.select("path", "key", "name", "block_time", "sample", *(F.round(F.get("values", F.lit(i)), 2).alias(f"v{i}") for i in (0, 1)))
