"""Column expressions: picture and clock rules, names, camera algebra, filters' closed forms, angles.

Missing values are NULL everywhere; expressions give NULL for NULL input and never NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- picture -----------------------------------------------------------------------------------------


def in_frame(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a point lies on the picture, whose pixels are centred on whole numbers."""
    return F.coalesce((x >= -0.5) & (x < width - 0.5) & (y >= -0.5) & (y < height - 0.5), F.lit(False))


def exportable(tracked: Column, hidden: Column) -> Column:
    return F.coalesce(tracked & ~hidden, F.lit(False))


def outside_by(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Distance of a point from the picture, 0 inside."""
    dx = F.greatest(-0.5 - x, x - (width - 0.5), F.lit(0.0))
    dy = F.greatest(-0.5 - y, y - (height - 0.5), F.lit(0.0))
    return F.hypot(dx, dy)


def onto_picture(v: Column, n: Column) -> Column:
    """Clamps a coordinate only if it is outside."""
    return F.when(v < -0.5, F.lit(0.0)).when(v >= n - 0.5, n - 1.0).otherwise(v)


def edge_tolerance(width: Column) -> Column:
    return F.greatest(F.lit(3.0), 0.005 * width)


def drift_limit(width: Column, diameter: Column) -> Column:
    return F.greatest(F.lit(6.0), 1.5 * diameter, 0.002 * width)


def one_based_xy(x: Column, y: Column, height: Column, flip: bool) -> tuple[Column, Column]:
    """Pixels counted from 1, with the origin at the top or (``flip``) at the bottom."""
    return x + 1, (height - y if flip else y + 1)


def centre_scale(p: Column, s: Column) -> Column:
    return (p + 0.5) * s - 0.5


def centre_unscale(p: Column, s: Column) -> Column:
    return (p + 0.5) / s - 0.5


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def box_diagonal(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Diagonal of a box whose last row and column belong to it."""
    return F.hypot(x1 - x0 + 1, y1 - y0 + 1)


# ---- clock -------------------------------------------------------------------------------------------


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def reference_time(frame: Column, offset: Column, rate: Column) -> Column:
    return (frame - offset) / rate


def local_frame(t: Column, offset: Column, rate: Column) -> Column:
    return rate * t + offset


def map_index(x: Column, src_ord: Column, dst_ord: Column) -> Column:
    """Nearest whole frame; a tie goes up when mapping to a later camera and down when mapping back."""
    return F.when(src_ord <= dst_ord, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


# ---- names -------------------------------------------------------------------------------------------


#: Every character that counts as white space around a name.
BLANKS = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def sanitize(name: Column) -> Column:
    clean = F.regexp_replace(F.translate(F.translate(name, ",\t", "__"), "\n", " "), f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("point"))


def casefolded(text: Column) -> Column:
    """A form in which texts that differ by case alone are equal, by Unicode's full folding (Cherokee in its small letters).

    Capitals of small letters fold what small letters alone don't: sharp and long s, ligatures, variants of
    Greek letters. The dotless i, which has no fold, sits that out as a private character.
    """
    capitals = F.upper(F.translate(F.lower(text), "\u0131", "\ue000"))
    return F.translate(F.lower(F.translate(capitals, "\ue000", "\u0131")), "\u03c2", "\u03c3")


def name_key(name: Column) -> Column:
    """The key by which cameras match landmarks."""
    return casefolded(sanitize(name))


def formula_safe(name: Column, fallback: str = "point") -> Column:
    """The name without a leading run that a spreadsheet would take for a formula."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"^[\s=+\-@]+", "")), F.lit("")), F.lit(fallback))


def qualified(animal: Column, part: Column) -> Column:
    return F.concat_ws(" ", F.nullif(animal, F.lit("")), part)


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


#: Other spellings of joints, by the name they stand for.
JOINT_ALIASES = {
    "left_big_toe_tip": "left_big_toe",
    "right_big_toe_tip": "right_big_toe",
    "left_small_toe_tip": "left_small_toe",
    "right_small_toe_tip": "right_small_toe",
}


def canonical_joint(name: Column) -> Column:
    """Lower case with single underscores, sides spelled out, aliases replaced."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[ _\-]+", "_")
    sided = F.regexp_replace(F.regexp_replace(plain, "^l_", "left_"), "^r_", "right_")
    known = F.create_map(*(F.lit(x) for pair in JOINT_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, sided), sided)


def valid_spec(spec: Column) -> Column:
    """Grammar of derived landmarks: tip, centroid, midline:<share> or ext:<role>."""
    return F.coalesce(spec.rlike(r"^(tip|centroid|midline:(0(\.\d+)?|1(\.0+)?|\.\d+)|ext:(L|R|FL|FR|HL|HR))$"), F.lit(False))


# ---- cameras (eleven linear coefficients) --------------------------------------------------------------


def dlt_denominator(c: list[Column], x: Column, y: Column, z: Column) -> Column:
    return c[8] * x + c[9] * y + c[10] * z + 1


def dlt_project(c: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    w = dlt_denominator(c, x, y, z)
    return F.try_divide(c[0] * x + c[1] * y + c[2] * z + c[3], w), F.try_divide(c[4] * x + c[5] * y + c[6] * z + c[7], w)


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve3(m: list[list[Column]], r: list[Column]) -> tuple[Column, Column, Column]:
    """Cramer's rule; NULL where the system is singular."""
    d = det3(m)
    swap = lambda k: [[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return tuple(F.try_divide(det3(swap(k)), d) for k in range(3))


def camera_centre(c: list[Column]) -> tuple[Column, Column, Column]:
    return solve3([[c[0], c[1], c[2]], [c[4], c[5], c[6]], [c[8], c[9], c[10]]], [-c[3], -c[7], F.lit(-1.0)])


def front_sign(c: list[Column], probe: tuple[Column, Column, Column] | None = None) -> Column:
    """Sign of the denominator in front of the camera: from a probe point, else from the determinant."""
    if probe is not None:
        return F.signum(dlt_denominator(c, *probe))
    return F.signum(det3([[c[0], c[1], c[2]], [c[4], c[5], c[6]], [c[8], c[9], c[10]]]))


def in_front(c: list[Column], x: Column, y: Column, z: Column, sign: Column) -> Column:
    return F.coalesce(sign * dlt_denominator(c, x, y, z) > 0, F.lit(False))


def dlt_ray(c: list[Column], u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Unit direction of the points that a pixel can show."""
    a = [c[0] - u * c[8], c[1] - u * c[9], c[2] - u * c[10]]
    b = [c[4] - v * c[8], c[5] - v * c[9], c[6] - v * c[10]]
    d = cross(a, b)
    n = norm(d)
    return tuple(F.try_divide(x, n) for x in d)


def calibrated(coefs: Column) -> Column:
    """Eleven finite numbers that aren't all zero."""
    fine = F.forall(coefs, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(coefs) == 11) & fine & F.exists(coefs, lambda v: v != 0), F.lit(False))


def brown_distort(x: Column, y: Column, k1: Column, k2: Column, k3: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """Forward radial and tangential distortion of normalised coordinates."""
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def brown_undistort(x: Column, y: Column, k1: Column, k2: Column, k3: Column, p1: Column, p2: Column, steps: int = 3) -> tuple[Column, Column]:
    """Fixed-point inverse of ``brown_distort`` in a fixed number of steps, as one fold over the pair."""

    def step(s: Column, _: Column) -> Column:
        p, q = s["a"], s["b"]
        r2 = p * p + q * q
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        return F.struct(((x - 2 * p1 * p * q - p2 * (r2 + 2 * p * p)) / radial).alias("a"), ((y - p1 * (r2 + 2 * q * q) - 2 * p2 * p * q) / radial).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("a"), y.alias("b")), step)
    return found["a"], found["b"]


# ---- verdicts ----------------------------------------------------------------------------------------


#: The picture side from which pixel limits grow, and the limits of good and usable residuals.
SCALED_SIDE, GOOD_PIXELS, OK_PIXELS = 1920.0, 1.5, 5.0


def residual_scale(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1.0), F.greatest(width, height) / SCALED_SIDE)


def residual_bands(width: Column, height: Column) -> tuple[Column, Column]:
    s = residual_scale(width, height)
    return GOOD_PIXELS * s, OK_PIXELS * s


def cell_verdict(residual: Column, n_cams: Column, good: Column, ok: Column) -> Column:
    """good, ok or poor; two cameras alone never make a good cell; empty without a residual."""
    return F.when(residual.isNull(), "").when((residual <= good) & (n_cams > 2), "good").when(residual <= ok, "ok").otherwise("poor")


# ---- filters, in closed form ---------------------------------------------------------------------------


#: Fixed values, as shares of half the frame rate: cutoffs from the first on filter nothing, none is proposed over
#: the second, and frequencies are read up to the third.
NO_FILTER, HIGHEST_CUTOFF, HIGHEST_FREQUENCY = 0.98, 0.9, 0.999


def kept_fraction(f: Column, cutoff: Column, fps: Column) -> Column:
    """Gain at frequency ``f`` of a second-order low-pass run forwards and backwards: 1 without a cutoff, 0 from half the frame rate on."""
    warped = lambda x: F.tan(math.pi * x / fps)
    none = cutoff.isNull() | (cutoff <= 0) | (cutoff >= NO_FILTER * fps / 2)
    return F.when(none, F.lit(1.0)).when(f >= fps / 2, F.lit(0.0)).otherwise(1 / (1 + F.pow(warped(f) / warped(cutoff), F.lit(4.0))))


def cutoff_keeping(f: Column, fps: Column, keep: float) -> Column:
    """The cutoff at which ``f`` keeps a share of its height, bounded by a share of half the frame rate."""
    top = F.tan(math.pi * F.least(f, HIGHEST_FREQUENCY * fps / 2) / fps)
    return F.least(fps / math.pi * F.atan(top / (1 / keep - 1) ** 0.25), HIGHEST_CUTOFF * fps / 2)


def edge_width(fps: Column, cutoff: Column) -> Column:
    return F.ceil(fps / cutoff).cast("long")


def score_to_confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-(score - 2)))


# ---- vectors and angles --------------------------------------------------------------------------------


def dot(u: list[Column], v: list[Column]) -> Column:
    return sum((a * b for a, b in zip(u[1:], v[1:], strict=True)), u[0] * v[0])


def norm(u: list[Column]) -> Column:
    return F.sqrt(dot(u, u))


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def minus(u: list[Column], v: list[Column]) -> list[Column]:
    return [a - b for a, b in zip(u, v, strict=True)]


def interior_angle(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Unsigned angle at ``b`` in degrees; NULL where a side has no length."""
    u, v = minus(a, b), minus(c, b)
    cos = F.try_divide(dot(u, v), norm(u) * norm(v))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def signed_angle(u: list[Column], v: list[Column], axis: list[Column]) -> Column:
    """Angle from ``u`` to ``v`` about ``axis`` in degrees."""
    return F.degrees(F.atan2(dot(cross(u, v), axis), dot(u, v)))


def twist(shoulders: list[Column], hips: list[Column], trunk: list[Column]) -> Column:
    """Rotation of the shoulder line against the hip line about the trunk's axis."""
    n = norm(trunk)
    axis = [F.try_divide(x, n) for x in trunk]
    flat = lambda u: [x - dot(u, axis) * a for x, a in zip(u, axis, strict=True)]
    return signed_angle(flat(hips), flat(shoulders), axis)


def fold(v: Column, lo: float, hi: float) -> Column:
    """Wraps an angle into (lo, hi]; values that are inside stay as they are."""
    return F.when((v > lo) & (v <= hi), v).otherwise(hi - F.pmod(hi - v, F.lit(360.0)))


def closest_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    t = F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return ax + t * (bx - ax), ay + t * (by - ay)


def closest_on_polyline(line: Column, px: Column, py: Column) -> Column:
    """struct(d, x, y) of the nearest point on ``array<struct<x,y>>``."""
    steps = F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0)))

    def one(i: Column) -> Column:
        a, b = F.get(line, i), F.coalesce(F.get(line, i + 1), F.get(line, i))
        x, y = closest_on_segment(px, py, a["x"], a["y"], b["x"], b["y"])
        return F.struct(F.hypot(px - x, py - y).alias("d"), x.alias("x"), y.alias("y"))

    return F.when(F.size(line) > 0, F.array_min(F.transform(steps, one)))


def resampled_path(path: Column, n: int) -> Column:
    """``n`` >= 2 points evenly spaced along a polyline of (x, y) structs; a lone point repeats, an empty path gives none."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.hypot(F.get(path, i)["x"] - F.get(path, i - 1)["x"], F.get(path, i)["y"] - F.get(path, i - 1)["y"]))
    arc = F.aggregate(steps, F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def at(i: Column) -> Column:
        want = i * F.element_at(arc, -1) / (n - 1)
        # The last corner at or before the wanted length, but for the end.
        k = F.least(F.size(F.filter(arc, lambda a: a <= want)), F.size(path) - 1) - 1
        share = F.coalesce(F.try_divide(want - F.get(arc, k), F.get(arc, k + 1) - F.get(arc, k)), F.lit(0.0))
        lerp = lambda c: F.get(path, k)[c] + share * (F.get(path, k + 1)[c] - F.get(path, k)[c])
        return F.struct(lerp("x").alias("x"), lerp("y").alias("y"))

    line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
    return F.when(F.size(path) >= 2, line).when(F.size(path) == 1, F.array_repeat(F.get(path, F.lit(0)), n)).otherwise(F.slice(path, 1, 0))
