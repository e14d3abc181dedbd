"""Readers and writers of point tracks: the engine's own long form and the layouts of common trackers.

Layouts are told apart by their headers. Small headers are read on the driver, data by Spark; positional
layouts (row k is frame k) are read a whole file at a time, so that rows keep their numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionframe.functions.scalars import one_based_xy
from motionframe.operators.reshape import best_instances, wide

OWN = "camera string, name string, frame long, x float, y float, confidence float, visible boolean, hand_placed boolean, imported boolean, hidden boolean, radius float"


def header(spark: SparkSession, path: str, n: int = 4) -> list[list[str]]:
    """The first lines of a text file, split at commas."""
    rows = spark.read.text(path).limit(n).collect()
    return [[c.strip() for c in r["value"].lstrip("﻿").split(",")] for r in rows]


def detect(spark: SparkSession, path: str) -> str:
    """``dlc``, ``dltdv``, ``sleap``, ``xyz``, ``xyzpts``, ``anipose`` or ``own``."""
    rows = header(spark, path)
    first = rows[0] if rows else []
    if len(first) == 1 and ";" in first[0]:
        raise ValueError("columns are separated by semicolons; save the table with commas")
    low = [c.lower() for c in first]
    if low[:1] == ["scorer"]:
        return "dlc"
    if first and all(re.fullmatch(r"pt\d+_cam\d+_[XYUV]", c) for c in first):
        return "dltdv"
    if first and all(re.fullmatch(r"pt\d+_[XYZ]", c) for c in first):
        return "xyzpts"
    if "frame_idx" in low:
        return "sleap"
    if any(c.endswith("_error") for c in low):
        return "anipose"
    if low[:1] == ["frame"] and any(c.endswith("_X") for c in first):
        return "xyz"
    if "frame" in low and "x" in low and "y" in low:
        return "own"
    raise ValueError("no known layout of tracks")


def finite(c: Column) -> Column:
    """A number, or NULL for blanks, text and NaN."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def _numbered(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(row, cells) of a text file's lines after the header, blank lines included, in file order."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\Z", ""), r"\r?\n")).alias("row", "line"))
    return rows.where(F.col("row") >= skip).select((F.col("row") - skip).cast("long").alias("row"), F.split("line", ",", -1).alias("cells"))


def _cell(i: int) -> Column:
    return finite(F.trim(F.get("cells", F.lit(i))))


def read_own(spark: SparkSession, path: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Own long tables: columns by name in any order, unknown ones ignored, missing ones at their defaults.

    ``folders`` names the keys of a tree of tables, as ``write_own`` lays it out; they come first.
    """
    d = spark.read.option("header", True).csv(path)
    have = {c.strip().lower(): c for c in d.columns}
    missing = {"frame", "x", "y"} - set(have)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    flag = lambda c: F.coalesce(F.lower(F.trim(c)).isin("1", "true"), F.lit(False))
    out = []
    for f in T._parse_datatype_string(OWN).fields:
        if f.name in folders:
            continue
        c = F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None).cast("string")
        if isinstance(f.dataType, T.BooleanType):
            c = flag(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        else:
            c = finite(c).cast(f.dataType)
        out.append(c.alias(f.name))
    return d.select(*folders, *out)


def read_dlc(spark: SparkSession, path: str) -> DataFrame:
    """(name, frame, x, y, confidence): three header rows, then a frame and three columns for each part."""
    parts, coords = header(spark, path, 3)[1:3]
    rows = _numbered(spark, path, 3)
    at = {(p, c): i for i, (p, c) in enumerate(zip(parts, coords, strict=True)) if i}
    names = list(dict.fromkeys(parts[1:]))
    chance = lambda n: F.least(F.greatest(F.coalesce(_cell(at[n, "likelihood"]), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    points = F.array(*(F.struct(F.lit(n).alias("name"), _cell(at[n, "x"]).alias("x"), _cell(at[n, "y"]).alias("y"), chance(n).alias("confidence")) for n in names))
    d = rows.where(F.size("cells") > 1).select(_cell(0).cast("long").alias("frame"), F.inline(points))
    return d.where("x is not null and y is not null").select("name", "frame", "x", "y", "confidence")


def read_dltdv(spark: SparkSession, path: str, names: dict[int, str] | None = None, origin: int = 1) -> DataFrame:
    """(cam, name, frame, x, y): a column pair for each point and camera, row k is frame k, pixels counted from ``origin``."""
    head = header(spark, path, 1)[0]
    at = {tuple(map(int, m.group(1, 2))) + (m[3],): i for i, h in enumerate(head) if (m := re.fullmatch(r"pt(\d+)_cam(\d+)_([XYUV])", h))}
    first, second = ("U", "V") if any(k[2] == "U" for k in at) else ("X", "Y")
    pairs = sorted({k[:2] for k in at})
    points = F.array(*(F.struct(F.lit(c).alias("cam"), F.lit((names or {}).get(p, f"pt{p}")).alias("name"), (_cell(at[p, c, first]) - origin).alias("x"), (_cell(at[p, c, second]) - origin).alias("y")) for p, c in pairs))
    return _numbered(spark, path, 1).select(F.col("row").alias("frame"), F.inline(points)).where("x is not null and y is not null").select("cam", "name", "frame", "x", "y")


def read_sleap(spark: SparkSession, path: str) -> DataFrame:
    """(name, frame, x, y, confidence, hand_placed) of the one-row-per-instance layout; the best instance of a frame counts."""
    d = spark.read.option("header", True).csv(path)
    nodes = [c[:-2] for c in d.columns if c.endswith(".x")]
    score = F.col("`instance.score`") if "instance.score" in d.columns else F.lit(None).cast("string")
    col = lambda n, k: finite(F.col(f"`{n}.{k}`")) if f"{n}.{k}" in d.columns else F.lit(None).cast("double")
    points = F.array(*(F.struct(F.lit(n).alias("name"), col(n, "x").alias("x"), col(n, "y").alias("y"), col(n, "score").alias("s")) for n in nodes))
    best = best_instances(d.withColumns({"frame": finite(F.col("frame_idx")).cast("long"), "score": finite(score)}))
    long = best.select("frame", F.col("score").isNull().alias("hand_placed"), F.inline(points)).where("x is not null and y is not null")
    chance = F.when(F.col("hand_placed") | F.col("s").isNull(), 1.0).otherwise(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)))
    return long.select("name", "frame", "x", "y", chance.alias("confidence"), "hand_placed")


def read_points3d(spark: SparkSession, path: str) -> DataFrame:
    """(name, frame, x, y, z, residual, n_cams) from own, positional or per-point error layouts."""
    kind, head = detect(spark, path), header(spark, path, 1)[0]
    at = {h: i for i, h in enumerate(head)}
    number = lambda h: _cell(at[h]) if h in at else F.lit(None).cast("double")
    if kind == "xyz":
        names, form, frame = [h[:-2] for h in head if h.endswith("_X")], "{}_X {}_Y {}_Z", number(head[0]).cast("long")
    elif kind == "xyzpts":
        names, form, frame = [h[:-2] for h in head if h.endswith("_X")], "{}_X {}_Y {}_Z", F.col("row")
    else:
        names, form = [h[:-2] for h in head if h.endswith("_x") and f"{h[:-2]}_error" in at], "{}_x {}_y {}_z"
        frame = number("fnum").cast("long") if "fnum" in at else F.col("row")
    point = lambda n: F.struct(F.lit(n).alias("name"), *(number(h).alias(a) for h, a in zip(form.replace("{}", n).split(" "), "xyz", strict=True)), number(f"{n}_error").alias("residual"), number(f"{n}_ncams").cast("int").alias("n_cams"))
    d = _numbered(spark, path, 1).select(frame.alias("frame"), F.inline(F.array(*(point(n) for n in names))))
    return d.where("x is not null and y is not null and z is not null").select("name", "frame", "x", "y", "z", "residual", "n_cams")


def read_offsets(spark: SparkSession, path: str, reference: str) -> DataFrame:
    """(camera, offset, rate) re-based so that ``reference`` has offset 0 and rate 1."""
    d = spark.read.option("header", True).csv(path).select(F.trim("name").alias("camera"), finite(F.col("offset")).alias("offset"), F.coalesce(finite(F.col("rate")), F.lit(1.0)).alias("rate"))
    base = d.where(F.lower("camera") == reference.lower()).select(F.col("offset").alias("o"), F.col("rate").alias("r"))
    return d.crossJoin(F.broadcast(base)).select("camera", (F.col("offset") - F.col("rate") / F.col("r") * F.col("o")).alias("offset"), (F.col("rate") / F.col("r")).alias("rate"))  # one row


def read_dlt_csv(spark: SparkSession, path: str) -> DataFrame:
    """(cam, coefs): eleven rows, a column for each camera; the first row tells how many there are. Columns are positions of an array, so the plan doesn't grow with them."""
    rows = _numbered(spark, path, 0)
    n = rows.where("row = 0").agg(F.max(F.size("cells"))).scalar()
    cam = rows.where(F.size("cells") >= n).select("row", F.posexplode("cells").alias("cam", "cell")).where(F.col("cam") < n)
    cam = cam.select("row", "cam", finite(F.trim("cell")).alias("v"))
    return cam.groupBy("cam").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "v"))), lambda r: r["v"]).alias("coefs"))


def write_own(cells: DataFrame, path: str) -> None:
    """Long table, one folder for each camera and landmark; empty cells are missing values."""
    cells.withColumns({c: F.col(c).cast("int") for c, t in cells.dtypes if t == "boolean"}).write.mode("overwrite").option("header", True).option("nullValue", "").partitionBy("camera", "name").csv(path)


def wide_lines(cells: DataFrame, names: list[str], camera: str) -> DataFrame:
    """frame, then x, y and visible for each landmark, blank where there is no exported cell."""
    d = cells.where((F.col("camera") == camera) & ~F.col("hidden")).withColumn("visible", F.col("visible").cast("int"))
    return wide(d, names, ("x", "y", "visible")).drop("camera").orderBy("frame")


def dlc_table(cells: DataFrame, names: list[str], camera: str) -> DataFrame:
    """frame, then x, y and likelihood for each part; a missing part has likelihood 0."""
    d = cells.where((F.col("camera") == camera) & ~F.col("hidden")).withColumnRenamed("confidence", "likelihood")
    w = wide(d, names, ("x", "y", "likelihood")).drop("camera")
    return w.withColumns({f"{n}_likelihood": F.coalesce(f"{n}_likelihood", F.lit(0.0)) for n in names}).orderBy("frame")


def dlc_lines(cells: DataFrame, names: list[str], camera: str, scorer: str = "motionframe") -> DataFrame:
    """The three header rows and the data rows of ``dlc_table`` as text lines in order."""
    table = dlc_table(cells, names, camera)
    heads = ["scorer" + f",{scorer}" * (3 * len(names)), "bodyparts" + "".join(f",{n}" * 3 for n in names), "coords" + ",x,y,likelihood" * len(names)]
    head = cells.sparkSession.createDataFrame([(i - 3, h) for i, h in enumerate(heads)], "ord long, value string")
    values = [F.coalesce(F.col(f"`{n}_{v}`").cast("string"), F.lit("")) for n in names for v in ("x", "y", "likelihood")]
    return head.union(table.select(F.col("frame").alias("ord"), F.concat_ws(",", F.col("frame").cast("string"), *values))).orderBy("ord").select("value")


def dltdv_table(cells: DataFrame, names: list[str], camera: str, height: int, frames: int, flip: bool = True) -> DataFrame:
    """Positional table: row k is frame k, NaN where there is no exported cell, pixels counted from 1."""
    x, y = one_based_xy(F.col("x"), F.col("y"), F.lit(height), flip)
    d = cells.where((F.col("camera") == camera) & ~F.col("hidden")).select("camera", "name", "frame", x.alias("X"), y.alias("Y"))
    spine = cells.sparkSession.range(frames).withColumnRenamed("id", "frame")
    w = spine.join(wide(d, names, ("X", "Y")).drop("camera"), "frame", "left").orderBy("frame")
    nan = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(float("nan")))
    return w.select(*(nan(f"{n}_{a}").alias(f"pt{i + 1}_cam1_{a}") for i, n in enumerate(names) for a in "XY"))


def points3d_table(points: DataFrame, names: list[str]) -> DataFrame:
    """frame, then X, Y and Z for each landmark."""
    d = points.select("frame", "name", *(F.col(c).alias(c.upper()) for c in "xyz"))
    return wide(d, names, ("X", "Y", "Z"), ("frame",)).orderBy("frame")


# ---- several animals, events, clocks ---------------------------------------------------------------------------------

#: The individual that holds the points of no animal.
SINGLE = "single"


def dlc_multi_lines(cells: DataFrame, animals: list[str], parts: list[str], singles: list[str], scorer: str = "motionframe") -> DataFrame:
    """The four header rows (scorer, individuals, bodyparts, coords) and a row a frame of one camera's cells (animal, name, frame, x, y, confidence, hidden).

    Every animal has a column triple for each part that animals share, points of no animal stand under
    ``single``; a missing cell is blank with likelihood 0.
    """
    columns = [(a, p) for a in animals for p in parts] + [(None, n) for n in singles]
    clean = lambda s: s.replace(",", "_").replace("\t", "_").replace("\n", " ")
    owner = [clean(a) if a is not None else SINGLE for a, _ in columns]
    heads = ["scorer" + f",{scorer}" * (3 * len(columns)), "individuals" + "".join(f",{o}" * 3 for o in owner), "bodyparts" + "".join(f",{clean(p)}" * 3 for _, p in columns), "coords" + ",x,y,likelihood" * len(columns)]
    at = lambda a, p: (F.col("name") == p) & F.col("animal").eqNullSafe(F.lit(a))
    cell = [F.max(F.when(at(a, p), F.col(v))).alias(f"c{i}_{v}") for i, (a, p) in enumerate(columns) for v in ("x", "y", "confidence")]
    wide_rows = cells.where(~F.col("hidden")).groupBy("frame").agg(*cell)
    values = [F.coalesce(F.col(f"c{i}_{v}").cast("string"), F.lit("0.0" if v == "confidence" else "")) for i in range(len(columns)) for v in ("x", "y", "confidence")]
    head = cells.sparkSession.createDataFrame([(i - 4, h) for i, h in enumerate(heads)], "ord long, value string")
    return head.union(wide_rows.select(F.col("frame").alias("ord"), F.concat_ws(",", F.col("frame").cast("string"), *values))).orderBy("ord").select("value")


def read_dlc_multi(spark: SparkSession, path: str) -> DataFrame:
    """(animal, name, frame, x, y, confidence) of the layout with individuals; ``animal`` is NULL for single points."""
    _, owners, parts, coords = header(spark, path, 4)
    at = {(o, p, c): i for i, (o, p, c) in enumerate(zip(owners, parts, coords, strict=True)) if i}
    pairs = list(dict.fromkeys(k[:2] for k in at))
    chance = lambda o, p: F.least(F.greatest(F.coalesce(_cell(at[o, p, "likelihood"]), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    point = lambda o, p: F.struct(F.lit(None if o == SINGLE else o).cast("string").alias("animal"), F.lit(p).alias("name"), _cell(at[o, p, "x"]).alias("x"), _cell(at[o, p, "y"]).alias("y"), chance(o, p).alias("confidence"))
    d = _numbered(spark, path, 4).where(F.size("cells") > 1).select(_cell(0).cast("long").alias("frame"), F.inline(F.array(*(point(o, p) for o, p in pairs))))
    return d.where("x is not null and y is not null").select("animal", "name", "frame", "x", "y", "confidence")


def sleap_table(cells: DataFrame, nodes: list[str], scene: str = "scene") -> DataFrame:
    """track, frame_idx, instance.score, then x, y and score of each node: one row for each animal and frame with a cell, the points of no animal as a track of their own."""
    fixed = lambda c, n: F.format_number(c, n)
    plain = lambda c, n: F.replace(fixed(c, n), F.lit(","), F.lit(""))
    node = lambda n, v: F.max(F.when(F.col("name") == n, F.col(v)))
    cols = [plain(node(n, v), 4 if v == "confidence" else 3).alias(f"{n}.{'score' if v == 'confidence' else v}") for n in nodes for v in ("x", "y", "confidence")]
    d = cells.where(~F.col("hidden") & F.col("name").isin(nodes)).withColumn("track", F.coalesce("animal", F.lit(scene)))
    return d.groupBy("track", F.col("frame").alias("frame_idx")).agg(plain(F.avg("confidence"), 4).alias("instance.score"), *cols)


def write_events(events: DataFrame, notes: DataFrame, path: str) -> None:
    """CSV of events (name, start, end, note, author), then of notes (frame, text, author) as events of one frame; commas, quotes and line breaks survive."""
    rows = events.select("name", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "note", "author")
    rows = rows.unionByName(notes.select(F.lit("note").alias("name"), F.col("frame").alias("start_frame"), F.col("frame").alias("end_frame"), F.col("text").alias("note"), "author"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end, note, author) of an events CSV; a note or author that isn't there is empty."""
    d = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return d.select(text("name"), finite(F.col("start_frame")).cast("long").alias("start"), finite(F.col("end_frame")).cast("long").alias("end"), text("note"), text("author"))


def write_offsets(cameras: DataFrame, path: str) -> None:
    """CSV of clocks (camera, ord, offset, rate): the camera's number from 1, its name, offset and rate."""
    cameras.select((F.col("ord") + 1).alias("camera"), F.col("camera").alias("name"), "offset", "rate").write.option("header", True).csv(path)
