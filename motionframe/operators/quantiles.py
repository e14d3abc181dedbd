"""Exact medians without gathering a group's values in one task.

A quantile sketch, which combines before the shuffle, brackets the median; values under the bracket are only
counted, and those inside it (four parts in ``ACCURACY`` of the rows, besides ties, which are counted by
value) are ranked by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most one part in this many.
ACCURACY = 10_000


def medians(d: DataFrame, value: Column, keys: tuple[str, ...] = (), name: str = "median") -> DataFrame:
    """(keys, ``name``): exact median of the values that aren't NULL, the mean of both middle ones for even counts.

    Groups without a value have no row; without keys there is always one, NULL for no values. Keys may be NULL; a key that holds most rows costs no more, for its
    rows meet the bracket by a join whose other side is one row for each group.
    """
    reach = 2 / ACCURACY
    v = d.select(*keys, value.cast("double").alias("__v")).where("__v IS NOT NULL")
    ends = F.percentile_approx("__v", [0.5 - reach, 0.5 + reach], ACCURACY)
    bracket = v.groupBy(*keys).agg(ends.alias("__e")).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.get("__e", F.lit(0)).alias("__lo"), F.get("__e", F.lit(1)).alias("__hi"))
    if keys:
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        v = v.join(bracket, same)
    else:
        v = v.withColumns({"__lo": bracket.select("__lo").scalar(), "__hi": bracket.select("__hi").scalar()})
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    # One row for each distinct value inside, one (NULL, first) for all below, one for all above.
    side = F.when(F.col("__v") < F.col("__lo"), -1).when(inside, 0).otherwise(1)
    counts = v.groupBy(*keys, side.alias("__side"), F.when(inside, F.col("__v")).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("__n").over(w.orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"__to": upto, "__all": F.sum("__n").over(w)})
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    hit = lambda r: (F.col("__to") > r) & (F.col("__to") - F.col("__n") <= r)
    return ranked.groupBy(*keys).agg(((F.max(F.when(hit(low), F.col("__v"))) + F.max(F.when(hit(high), F.col("__v")))) / 2).alias(name))
