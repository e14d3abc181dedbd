"""Where a landmark seen by one camera can be in another: epipolar segments, their crossings, and targets for re-tracking.

A viewing ray is s -> centre + s * direction, s >= 0. In another camera it is the segment from the image of the
centre to the vanishing point; being in front of that camera and inside its picture are linear conditions on s,
so the kept part is found in closed form, in built-in expressions. A lens bends the segment, which is then
sampled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.functions.scalars import camera_centre, closest_on_polyline, cross, dot, edge_tolerance, front_sign, let, onto_picture, outside_by

#: Lines within this angle don't cross, and how far a curve reaches beyond the picture, in shares of its size.
PARALLEL_DEGREES, MARGIN = 5.0, 0.25
FAR = 1e300


def _coefs(c: str) -> list[Column]:
    return [F.get(c, F.lit(i)) for i in range(11)]


def _homogeneous(c: list[Column], p: list[Column], one: float) -> list[Column]:
    last = [c[3], c[7], F.lit(1.0)]
    return [c[4 * k] * p[0] + c[4 * k + 1] * p[1] + c[4 * k + 2] * p[2] + one * last[k] for k in range(3)]


def _triple(c: str) -> list[Column]:
    return [F.get(c, F.lit(i)) for i in range(3)]


def pair_segments(obs: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = ("name", "frame"), probe: tuple[float, float, float] = (0.0, 0.0, 0.0), margin: float = MARGIN) -> DataFrame:
    """(keys, cam, dst, segment) of each observation (keys, cam, u, v) in every other camera of (cam, coefs, width, height), a handful.

    ``segment`` holds two (x, y), from the near end to the far end of the ray through the observed pixel, inside
    the other picture and its margin; rays that don't land there have no row. ``probe`` is a point in front of
    all cameras. Each step is bound once, so that nothing is computed twice.
    """
    at = tuple(map(F.lit, probe))
    k = _coefs("coefs")
    known = cameras.select("cam", "coefs", "width", "height", F.array(*camera_centre(k)).alias("centre"), front_sign(k, at).alias("front"))
    left = known.select("cam", F.col("coefs").alias("__s"), F.col("centre").alias("__c"), F.col("front").alias("__fs"))
    right = known.select(F.col("cam").alias("dst"), F.col("coefs").alias("__d"), F.col("front").alias("__fd"), "width", "height")
    d = obs.join(F.broadcast(left.crossJoin(right).where("cam <> dst")), "cam")
    s, t, u, v = _coefs("__s"), _coefs("__d"), F.col("u"), F.col("v")
    w, high = F.col("width"), F.col("height")
    sides = ((0, -0.5 - margin * w, 1), (0, w - 0.5 + margin * w, -1), (1, -0.5 - margin * high, 1), (1, high - 0.5 + margin * high, -1))

    def image(ray: Column) -> Column:
        """Of the camera's centre (c) and of the ray's direction (r) in the other picture, homogeneous; the ray points to the side of its camera where the probe is."""
        way = [ray[k] for k in "xyz"]
        ahead = F.signum(F.col("__fs") * dot(s[8:11], way)) * F.col("__fd")
        c, r = _homogeneous(t, _triple("__c"), 1.0), _homogeneous(t, way, 0.0)
        return F.struct(*((F.col("__fd") * x).alias(f"c{i}") for i, x in enumerate(c)), *((ahead * x).alias(f"r{i}") for i, x in enumerate(r)))

    def clipped(h: Column) -> Column:
        """The range of s in which all conditions a + s * b >= 0 hold: in front of the camera, inside each side."""
        pairs = [(h["c2"], h["r2"])] + [(sign * (h[f"c{i}"] - e * h["c2"]), sign * (h[f"r{i}"] - e * h["r2"])) for i, e, sign in sides]
        pairs = F.array(*(F.struct(x.alias("a"), y.alias("b")) for x, y in pairs))
        lower = F.transform(pairs, lambda q: F.when(q["b"] > 0, -q["a"] / q["b"]).otherwise(F.when((q["b"] == 0) & (q["a"] < 0), FAR).otherwise(0.0)))
        upper = F.transform(pairs, lambda q: F.when(q["b"] < 0, -q["a"] / q["b"]).otherwise(FAR))
        return F.struct(F.greatest(F.array_max(lower), F.lit(0.0)).alias("lo"), F.array_min(upper).alias("hi"))

    def ends(h: Column, e: Column) -> Column:
        near = [h[f"c{i}"] + e["lo"] * h[f"r{i}"] for i in range(3)]
        far = [F.when(e["hi"] >= FAR, h[f"r{i}"]).otherwise(h[f"c{i}"] + e["hi"] * h[f"r{i}"]) for i in range(3)]
        return F.when(e["lo"] < e["hi"], F.array(*(F.struct((p[0] / p[2]).alias("x"), (p[1] / p[2]).alias("y")) for p in (near, far))))

    way = cross([s[0] - u * s[8], s[1] - u * s[9], s[2] - u * s[10]], [s[4] - v * s[8], s[5] - v * s[9], s[6] - v * s[10]])
    way = F.struct(*(x.alias(k) for k, x in zip("xyz", way, strict=True)))
    segment = let(way, lambda ray: let(image(ray), lambda h: let(clipped(h), lambda e: ends(h, e))))
    return d.select(*keys, "cam", "dst", segment.alias("segment")).where("segment is not null")


def sampled_curve(segment: Column, n: int, bend: Callable[[Column, Column], tuple[Column, Column]], inside: Callable[[Column, Column], Column]) -> Column:
    """``n`` points of a segment bent by a lens, those that land ``inside`` the raw picture; NULL for NULL."""
    a, b = F.get(segment, F.lit(0)), F.get(segment, F.lit(1))

    def at(i: Column) -> Column:
        t = i / (n - 1)
        x, y = bend(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.when(segment.isNotNull(), F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at), lambda p: inside(p["x"], p["y"])))


def crossing(lines: str, x: Column, y: Column) -> Column:
    """struct(mode, x, y) of the point that an array of segments puts near (x, y): one, crossing or parallel; NULL without lines.

    One line gives its nearest point. Several give the least-squares crossing of the lines; where all are
    within five degrees of each other their crossing is noise, and the mean of the nearest points counts.
    """
    feet = F.transform(lines, lambda s: closest_on_polyline(s, x, y))

    def normal(s: Column) -> Column:
        """Of a segment: a unit normal (a, b), and c with a x + b y = c on its line."""
        p, q = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        n = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
        a, b = F.try_divide(p["y"] - q["y"], n), F.try_divide(q["x"] - p["x"], n)
        return F.struct(a.alias("a"), b.alias("b"), (a * p["x"] + b * p["y"]).alias("c"))

    def placed(g: Column) -> Column:
        total = lambda p, q: F.aggregate(g["n"], F.lit(0.0), lambda t, n: t + n[p] * n[q])
        least = F.array_min(F.flatten(F.transform(g["n"], lambda m: F.transform(g["n"], lambda n: F.abs(m["a"] * n["a"] + m["b"] * n["b"])))))
        mode = F.when(F.size(g["n"]) < 2, "one").when(F.degrees(F.acos(F.least(least, F.lit(1.0)))) < PARALLEL_DEGREES, "parallel").otherwise("crossing")
        return F.struct(mode.alias("mode"), *(total(*k).alias(k) for k in ("aa", "ab", "bb", "ac", "bc")), g["f"].alias("f"))

    def point(c: Column) -> Column:
        det = c["aa"] * c["bb"] - c["ab"] * c["ab"]
        mean = lambda k: F.aggregate(c["f"], F.lit(0.0), lambda t, f: t + f[k]) / F.size(c["f"])
        place = lambda k, crossed: F.when(c["mode"] == "crossing", F.try_divide(crossed, det)).when(c["mode"] == "one", F.get(c["f"], F.lit(0))[k]).otherwise(mean(k))
        return F.struct(c["mode"].alias("mode"), place("x", c["ac"] * c["bb"] - c["bc"] * c["ab"]).alias("x"), place("y", c["aa"] * c["bc"] - c["ab"] * c["ac"]).alias("y"))

    known = F.struct(feet.alias("f"), F.filter(F.transform(lines, normal), lambda n: n["a"].isNotNull()).alias("n"))
    return F.when(F.size(lines) > 0, let(known, lambda g: let(placed(g), point)))


def ray_targets(obs: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = ("name", "frame")) -> DataFrame:
    """(keys, cam, mode, lines, x, y, outside): where the other cameras' rays put a landmark in each camera.

    Lines are those that land in the picture and its margin; the crossing nearest to the camera's own view is
    taken, or to its centre where it has none. A point further outside the picture than the edge tolerance has no x and y,
    only its distance; one that is a little outside goes to the border.
    """
    own = obs.select(*keys, F.col("cam").alias("dst"), F.col("u").alias("__u"), F.col("v").alias("__v"))
    lines = pair_segments(obs, cameras, keys)
    # A group has a line for each other camera.
    d = lines.groupBy(*keys, "dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("cam", "segment"))), lambda s: s["segment"]).alias("__lines"))
    d = d.join(own, [*keys, "dst"], "left").join(F.broadcast(cameras.select(F.col("cam").alias("dst"), "width", "height")), "dst")
    d = d.withColumns({"__u": F.coalesce("__u", F.col("width") / 2.0), "__v": F.coalesce("__v", F.col("height") / 2.0)})
    d = d.withColumn("__t", crossing("__lines", F.col("__u"), F.col("__v")))
    x, y, w, h = F.col("__t.x"), F.col("__t.y"), F.col("width").cast("double"), F.col("height").cast("double")
    off = outside_by(x, y, w, h)
    near = off <= edge_tolerance(w)
    return d.select(*keys, F.col("dst").alias("cam"), F.col("__t.mode").alias("mode"), F.size("__lines").alias("lines"), F.when(near, onto_picture(x, w)).alias("x"), F.when(near, onto_picture(y, h)).alias("y"), off.alias("outside"))
