"""Triangulation as a grouped aggregate, leave-one-out blame, reports, incremental recomputation.

A point's linear equations are summed into nine numbers and solved in closed form. Its observations travel
as (camera, u, v), one per camera; coefficients are looked up in the camera table, a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionframe.functions.scalars import cell_verdict, dlt_project, residual_bands, solve3
from motionframe.operators.quantiles import medians
from motionframe.operators.runs import runs
from motionframe.sources.scratch import written

KEYS = ("name", "frame")
_ATA = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _rows(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations with their two equations ``a . X = r``."""
    d = obs.join(F.broadcast(cameras.select("cam", "coefs")), "cam")
    c = [F.get("coefs", F.lit(i)) for i in range(11)]
    u, v = F.col("u"), F.col("v")
    a = [u * c[8 + k] - c[k] for k in range(3)]
    b = [v * c[8 + k] - c[4 + k] for k in range(3)]
    return d.withColumns({"__a": F.array(*a), "__b": F.array(*b), "__p": c[3] - u, "__q": c[7] - v})


def _coefficients(cameras: DataFrame) -> Column:
    """The camera table as one map, a scalar subquery, so that no row has to carry coefficients through a shuffle."""
    return cameras.agg(F.map_from_entries(F.collect_list(F.struct("cam", "coefs")))).scalar()


def _terms() -> list[Column]:
    a, b = (lambda k: F.get("__a", F.lit(k))), (lambda k: F.get("__b", F.lit(k)))
    square = [a(i) * a(j) + b(i) * b(j) for i, j in _ATA]
    return square + [a(i) * F.col("__p") + b(i) * F.col("__q") for i in range(3)]


def _solved(s: list[Column]) -> tuple[Column, Column, Column]:
    m = [[s[0], s[1], s[2]], [s[1], s[3], s[4]], [s[2], s[4], s[5]]]
    return solve3(m, s[6:])


def triangulate(obs: DataFrame, cameras: DataFrame, least: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, x, y, z, residual, n_cams) from (keys, cam, u, v); NULL where fewer than ``least`` cameras see a point.

    The observations of a point stay together (one per camera), so its error is computed in the same group.
    """
    rows = _rows(obs, cameras)
    sums = [F.sum(t).alias(f"__s{i}") for i, t in enumerate(_terms())]
    seen = F.collect_list(F.struct("cam", "u", "v")).alias("__o")
    d = rows.groupBy(*keys).agg(*sums, F.count("*").cast("int").alias("n_cams"), seen)
    x, y, z = _solved([F.col(f"__s{i}") for i in range(9)])
    enough = F.col("n_cams") >= least
    d = d.withColumns({"x": F.when(enough, x), "y": F.when(enough, y), "z": F.when(enough, z), "__c": _coefficients(cameras)})
    d = d.withColumn("__e", _square_error(F.col("__o"), F.col("__c"), F.col("x"), F.col("y"), F.col("z")))
    residual = F.sqrt(F.try_divide(F.col("__e"), F.greatest(2 * F.col("n_cams") - 3, F.lit(1)).cast("double")))
    return d.select(*keys, "x", "y", "z", residual.alias("residual"), F.when(enough & F.col("x").isNotNull(), F.col("n_cams")).otherwise(0).alias("n_cams"))


def _square_error(seen: Column, coefs: Column, x: Column, y: Column, z: Column) -> Column:
    def one(o: Column) -> Column:
        u, v = dlt_project([F.get(F.element_at(coefs, o["cam"]), F.lit(i)) for i in range(11)], x, y, z)
        return (u - o["u"]) * (u - o["u"]) + (v - o["v"]) * (v - o["v"])

    return F.aggregate(F.transform(F.array_sort(seen), one), F.lit(0.0), lambda a, b: a + b)


def with_verdict(points: DataFrame, width: int, height: int) -> DataFrame:
    good, ok = residual_bands(F.lit(width), F.lit(height))
    return points.withColumn("verdict", cell_verdict(F.col("residual"), F.col("n_cams"), good, ok))


def report(points: DataFrame) -> DataFrame:
    """Median residual, solved share and two-camera share, for each name and (NULL) over all."""
    points = written(points.select("name", "x", "residual", "n_cams"), "points")  # read three times
    solved = F.col("x").isNotNull()
    shares = points.groupingSets([[], ["name"]], "name").agg(
        F.grouping("name").alias("__all"), F.count("*").alias("n"), F.avg(solved.cast("double")).alias("solved"),
        F.avg(F.when(solved, (F.col("n_cams") == 2).cast("double"))).alias("two_cameras"),
    )
    groups = F.explode(F.array(F.struct(F.lit(0).alias("m_all"), F.col("name").alias("m_name")), F.struct(F.lit(1).alias("m_all"), F.lit(None).cast("string").alias("m_name"))))
    middle = medians(points.select("residual", groups.alias("g")).select("residual", "g.*"), F.col("residual"), ("m_all", "m_name"))
    same = (F.col("__all") == F.col("m_all")) & F.col("name").eqNullSafe(F.col("m_name"))
    return shares.join(middle, same, "left").select("name", "n", "solved", F.col("median").alias("median_residual"), "two_cameras")


#: Fixed value: from this share of points that two cameras alone see, the cameras' agreement can't be called good.
TWO_CAMERA_CAP = 0.9


def report_verdict(reported: DataFrame, views: int, width: int, height: int) -> DataFrame:
    """(verdict, median_residual, worst, worst_residual, capped) of a ``report``: good, ok, poor, or empty where nothing is solved.

    ``worst`` is the landmark with the largest median, of equal ones the first by name. Two cameras can't
    see an error along the line that joins their views, so mostly two-camera points are never good.
    """
    good, ok = residual_bands(F.lit(width), F.lit(height))
    overall = F.col("name").isNull()
    of_all = lambda c: F.max(F.when(overall, F.col(c)))
    some = reported.where(overall | F.col("median_residual").isNotNull())
    worst = F.min_by(F.struct("name", "median_residual"), F.when(~overall, F.struct(-F.col("median_residual"), F.col("name"))))
    d = some.agg(of_all("median_residual").alias("median_residual"), of_all("two_cameras").alias("two"), worst.alias("w"))
    capped = (F.lit(views) <= 2) | (F.col("two") >= TWO_CAMERA_CAP)
    middle = F.col("median_residual")
    verdict = F.when(middle.isNull(), "empty").when((middle <= good) & ~capped, "good").when(middle <= ok, "ok").otherwise("poor")
    return d.select(verdict.alias("verdict"), "median_residual", F.col("w.name").alias("worst"), F.col("w.median_residual").alias("worst_residual"), F.coalesce(capped, F.lit(views <= 2)).alias("capped"))


def leave_one_out(obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(keys, cam, rest_residual, error): the point without camera ``cam``, its residual, and how far ``cam`` is from it in pixels.

    The nine sums of a point minus one camera's terms are the sums of the rest, so no self-join is needed.
    """
    rows = _rows(obs, cameras)
    terms = _terms()
    rows = rows.withColumns({f"__t{i}": t for i, t in enumerate(terms)})
    w = Window.partitionBy(*KEYS)
    rest = {f"__s{i}": F.sum(f"__t{i}").over(w) - F.col(f"__t{i}") for i in range(9)}
    d = rows.withColumns(rest | {"__n": F.count("*").over(w) - 1, "__o": F.collect_list(F.struct("cam", "u", "v")).over(w), "__c": _coefficients(cameras)})
    x, y, z = _solved([F.col(f"__s{i}") for i in range(9)])
    d = d.where("__n >= 2").withColumns({"x": x, "y": y, "z": z})
    others = F.filter("__o", lambda o: o["cam"] != F.col("cam"))
    e = _square_error(others, F.col("__c"), F.col("x"), F.col("y"), F.col("z"))
    u, v = dlt_project([F.get("coefs", F.lit(i)) for i in range(11)], F.col("x"), F.col("y"), F.col("z"))
    residual = F.sqrt(e / F.greatest(2 * F.col("__n") - 3, F.lit(1)))
    return d.select(*KEYS, "cam", residual.alias("rest_residual"), F.hypot(u - F.col("u"), v - F.col("v")).alias("error"))


def blame(loo: DataFrame, points: DataFrame, ok: float) -> DataFrame:
    """(keys, cam): the camera without which the rest agrees, if it does, by far better than with it or without any other."""
    best = F.sort_array(F.collect_list(F.struct("rest_residual", "cam"))).alias("r")
    d = loo.groupBy(*KEYS).agg(best).join(points.select(*KEYS, "residual"), list(KEYS))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    clear = (first["rest_residual"] <= ok) & (first["rest_residual"] <= 0.5 * F.col("residual")) & (second["rest_residual"] >= 1.5 * first["rest_residual"])
    return d.where(clear).select(*KEYS, first["cam"].alias("cam"), first["rest_residual"].alias("rest_residual"))


def disagreeing(errors: DataFrame, threshold: float, least: int = 3, gap: int = 2) -> DataFrame:
    """Stretches of (cam, name) whose error is over ``threshold``, joined across up to ``gap`` clean frames."""
    return runs(errors.where(F.col("error") > threshold), ("cam", "name"), gap, least)


def updated(old: DataFrame, changed: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """``old`` points with the (name, lo, hi) spans of ``changed`` recomputed from ``obs``; all other points stay as they are.

    Spans are exploded into keys, so both sides are equi-joins.
    """
    keys = changed.select("name", F.explode(F.sequence("lo", "hi")).alias("frame")).distinct()
    fresh = triangulate(obs.join(keys, list(KEYS), "left_semi"), cameras)
    return old.join(keys, list(KEYS), "left_anti").unionByName(fresh)


def similarity(points: DataFrame, basis: list[list[float]], origin: list[float], scale: float = 1.0) -> DataFrame:
    """Points in another world frame: ``scale * basis (X - origin)``."""
    d = [F.col(c) - o for c, o in zip("xyz", origin, strict=True)]
    return points.withColumns({c: scale * sum((d[j] * basis[i][j] for j in range(3)), F.lit(0.0)) for i, c in enumerate("xyz")})
