"""Exact top-k by inner product with an M-tree of paged metric nodes, searched best first.

Components become whole numbers (floor of ``scale`` times the component). Inner products turn into
Euclidean distances by one more coordinate that lifts all candidates to the largest norm in the table
(queries get 0 there): the nearest candidates are those with the greatest product.

The tree: a root of routing objects fitted on a bounded sample (``sample_rows``), nodes of at most about
``NODE_ROWS`` rows of one routing object, and pages of about ``PAGE_ROWS`` rows in a node. Nodes and pages
keep a routing object and a covering radius, entries their distance to their parent. All rows are indexed.

Queries visit the tree in two rounds. First bounds come from the sample; in the first round a query is sent to
the nodes of its nearest routing object only, which tightens its bound; in the second round it is sent to
those other routing objects whose covering radius still lets them hold a better partner. A node travels once
a round, and blocks of queries stream past it. In a node, pages wait in a heap by the least distance any
query of the block can have to them; a page is opened only while some query's bound can still beat its k-th
best, and entries are skipped where the stored parent distance proves them too far. Each pair of node and
block yields at most k rows a query, which are merged by query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; shorter vectors, empty ones too, count as padded with zeros; repeated rows are candidates each, but an
id asks once (with its least vector) and never finds itself; ties go to the smaller id; an empty table gives
an empty result; only the id and vector columns are read, so further columns can have any names. Numbers of
any size are multiplied exactly; a score that doesn't fit 64 bits is refused with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.llm._common import table, written

SAMPLE_ROWS, ROUTES = 2048, 64
LEAST = np.iinfo(np.int64).min
NODE_ROWS, PAGE_ROWS, BLOCK = 1024, 128, 64


def _matrix(parts, kind: str = "<i8") -> np.ndarray:
    """Rows of bytes as a float64 matrix, padded with zeros."""
    rows = [np.frombuffer(p, kind) for p in parts]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0) or 1))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return a[:, :width] if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _distances(a: np.ndarray, a_lift: np.ndarray, b: np.ndarray, b_lift: np.ndarray) -> np.ndarray:
    """Euclidean distances of lifted rows."""
    w = max(a.shape[1], b.shape[1])
    a, b = np.column_stack([_fit(a, w), a_lift]), np.column_stack([_fit(b, w), b_lift])
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _lift(a: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (a * a).sum(1), 0))


def _spread(points: np.ndarray, lift: np.ndarray, n: int) -> np.ndarray:
    """Indexes of up to ``n`` routing objects, each the farthest from those before it."""
    chosen = [0]
    near = _distances(points, lift, points[:1], lift[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, lift, points[chosen[-1:]], lift[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    w = max(q.shape[1], v.shape[1])
    q, v = _fit(q, w), _fit(v, w)
    if not q.size or not v.size or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * w < 2**53:
        return np.rint(q @ v.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(v.T)
    if max(abs(exact.min()), abs(exact.max())) >= 2**63:
        raise ValueError("a score doesn't fit 64 bits")
    return exact.astype(np.int64)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm): ``v`` holds little-endian 64-bit numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, x in zip(f["vec_id"], f["x"], strict=True):
                v = np.floor(scale * np.asarray(x, np.float64))
                if np.isfinite(v).all() and np.abs(v).max(initial=0) >= 2**62:
                    raise ValueError("a component doesn't fit 62 bits")
                if np.isfinite(v).all():
                    out.append((i, v.astype("<i8").tobytes(), float((v * v).sum())))
            yield pd.DataFrame(out, columns=["vec_id", "v", "norm"])

    x = F.col(f"`{vector_col}`")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull())
    rows = vectors.where(usable).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
    return rows.where("vec_id is not null").mapInPandas(run, "vec_id long, v binary, norm double")


def build(rows: DataFrame, top: float, sample: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Nodes: (route, node, width, ids, vectors, page sizes, radii and distances as bytes) over all ``rows`` (vec_id, v); and the routing objects."""
    lift = _lift(sample, top)
    picked = _spread(sample, lift, ROUTES)
    routes, routes_lift = sample[picked], lift[picked]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a = _matrix(f["v"])
                near = _distances(a, _lift(a, top), routes, routes_lift).argmin(1).astype("int32")
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "route": near})

    routed = written(rows.select("vec_id", "v").mapInPandas(assign, "vec_id long, v binary, route int"), "routed")
    sizes = routed.groupBy("route").agg(F.count("*").alias("n"))  # at most ROUTES rows
    salted = routed.join(F.broadcast(sizes), "route").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / NODE_ROWS)))

    def node(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["vec_id", "v"])
        a = _matrix(f["v"])
        up = _lift(a, top)
        route = slice(key[0], key[0] + 1)
        pivots = _spread(a, up, -(-len(f) // PAGE_ROWS))
        to_pivot = _distances(a, up, a[pivots], up[pivots])
        page = to_pivot.argmin(1)
        order = np.argsort(page, kind="stable")
        own = to_pivot[np.arange(len(f)), page][order]
        counts = np.bincount(page, minlength=len(pivots))
        cuts = np.cumsum(counts)[:-1]
        radii = np.array([x.max(initial=0) for x in np.split(own, cuts)])
        above = _distances(a, up, routes[route], routes_lift[route])[:, 0]
        return pd.DataFrame([{
            "route": int(key[0]), "node": f"{key[0]}-{key[1]}", "width": a.shape[1], "ids": f["vec_id"].to_numpy("<i8")[order].tobytes(), "vectors": a[order].astype("<i8").tobytes(), "own": own.tobytes(),
            "pages": counts.astype("<i4").tobytes(), "pivots": a[pivots].astype("<i8").tobytes(), "radii": radii.tobytes(), "above": above[pivots].tobytes(),
            "routing": routes[route].astype("<i8").tobytes(), "radius": float(above.max()),
        }])

    schema = "route int, node string, width int, ids binary, vectors binary, own binary, pages binary, pivots binary, radii binary, above binary, routing binary, radius double"
    return salted.groupBy("route", "salt").applyInPandas(node, schema), routes


def search_node(n, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, top: float) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of up to k candidates a query in one node, none of which scores under ``floor``.

    Bounds carry a slack for rounding, so only what can't win is skipped.
    """
    w = int(n["width"])
    ids, vectors = np.frombuffer(n["ids"], "<i8"), np.frombuffer(n["vectors"], "<i8").reshape(-1, w).astype(float)
    own, radii, above = (np.frombuffer(n[c]) for c in ("own", "radii", "above"))
    ends = np.cumsum(np.frombuffer(n["pages"], "<i4"))
    norm, zero = (q * q).sum(1), np.zeros(len(q))
    slack = 1e-6 * (1 + np.sqrt(norm + top))
    floor = floor.astype(float)
    reach = lambda: np.sqrt(np.maximum(norm + top - 2 * floor, 0)) + slack  # noqa: E731  farthest a winner can be
    routing = np.frombuffer(n["routing"], "<i8")[None, :].astype(float)
    d_route = _distances(q, zero, routing, _lift(routing, top))[:, 0]
    far = reach()
    if not (d_route - n["radius"] <= far).any():
        return []
    # The stored distance of a page's pivot to the node's routing object bounds a query's distance to the pivot.
    coarse = np.abs(d_route[:, None] - above[None, :]) - radii[None, :]
    some = np.flatnonzero((coarse <= far[:, None]).any(0))
    pivots = np.frombuffer(n["pivots"], "<i8").reshape(-1, w)[some].astype(float)
    d_pivot = _distances(q, zero, pivots, _lift(pivots, top))
    bound = np.maximum(d_pivot - radii[some][None, :], 0)
    heap = [(float(bound[:, j].min()), j) for j in range(len(some))]
    heapq.heapify(heap)
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    while heap:
        _, j = heapq.heappop(heap)
        far = reach()
        asking = np.flatnonzero(bound[:, j] <= far)
        if not len(asking):
            continue
        p = some[j]
        rows = np.arange(ends[p - 1] if p else 0, ends[p])
        near = np.abs(d_pivot[asking, j][:, None] - own[rows][None, :]) <= far[asking][:, None]
        rows = rows[near.any(0)]
        scores = _products(q[asking], vectors[rows])
        for i, s in zip(asking, scores, strict=True):
            hit = np.flatnonzero(s >= floor[i])
            hit = hit[ids[rows[hit]] != q_ids[i]]
            if len(hit) > k:
                least = np.partition(s[hit], len(hit) - k)[len(hit) - k]
                hit = hit[s[hit] >= least]
            if len(hit):
                best[i] = sorted([*best[i], *((-int(s[h]), int(ids[rows[h]])) for h in hit)])[:k]
                if len(best[i]) == k:
                    floor[i] = max(floor[i], -best[i][-1][0])
    return [(int(i), v, -s) for i, found in zip(q_ids, best, strict=True) for s, v in found]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = written(whole_numbers(vectors, id_col, vector_col, scale), "vectors")
    top = rows.agg(F.max("norm")).first()[0] or 0.0
    some = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).select("vec_id", "v").collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample, sample_ids = _matrix([r["v"] for r in some]), np.array([r["vec_id"] for r in some])
    nodes, routes = build(rows, top, sample)
    nodes = written(nodes, "nodes")
    radius = np.full(len(routes), -np.inf)
    for r in nodes.groupBy("route").agg(F.max("radius").alias("radius")).collect():  # at most ROUTES rows
        radius[r["route"]] = r["radius"]
    lift = _lift(routes, top)
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def first_bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A first bound from the sample: the k-th best score among its other rows."""
        for f in frames:
            for at in range(0, len(f), BLOCK):
                part = f.iloc[at : at + BLOCK]
                ids = part["vec_id"].to_numpy("<i8")
                s = np.where(ids[:, None] == sample_ids[None, :], LEAST, _products(_matrix(part["v"]), sample))
                yield pd.DataFrame({"vec_id": ids, "v": part["v"].to_numpy(), "floor": np.sort(s, 1)[:, -k] if s.shape[1] >= k else np.full(len(s), LEAST)})

    asked = written(asking.mapInPandas(first_bounds, "vec_id long, v binary, floor long"), "queries")
    fields = "width int, ids binary, vectors binary, own binary, pages binary, pivots binary, radii binary, above binary, routing binary, radius double"
    columns = [c.split()[0] for c in fields.split(", ")]

    def visited(queries: DataFrame, nearest: bool) -> DataFrame:
        """Candidates (query_id, vec_id, score) from the nodes of each query's nearest routing object, or of all others that its bound admits."""

        def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                q, ids, floor = _matrix(f["v"]), f["vec_id"].to_numpy("<i8"), f["floor"].to_numpy("<i8")
                far = np.sqrt(np.maximum((q * q).sum(1) + top - 2 * floor.astype(float), 0))
                d = _distances(q, np.zeros(len(q)), routes, lift)
                home = np.where(np.isfinite(radius)[None, :], d, np.inf).argmin(1)[:, None] == np.arange(len(routes))[None, :] if len(q) else np.zeros(d.shape, bool)
                go = home if nearest else ~home & (d - radius[None, :] <= (far + 1e-6 * (1 + far))[:, None])
                out = []
                for r in range(len(routes)):
                    for part in (own[at : at + BLOCK] for own in [np.flatnonzero(go[:, r])] for at in range(0, len(own), BLOCK)):
                        out.append((r, q.shape[1], ids[part].tobytes(), q[part].astype("<i8").tobytes(), floor[part].tobytes()))
                yield pd.DataFrame(out, columns=["route", "q_width", "q_ids", "q", "floor"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            node: dict = {}
            for f in frames:
                found: list[tuple[int, int, int]] = []
                for n in f.to_dict("records"):
                    if n["q"] is None:
                        node = n
                    else:
                        q = np.frombuffer(n["q"], "<i8").reshape(-1, int(n["q_width"])).astype(float)
                        found += search_node(node, np.frombuffer(n["q_ids"], "<i8"), q, np.frombuffer(n["floor"], "<i8"), k, top)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        sent = queries.mapInPandas(blocks, "route int, q_width int, q_ids binary, q binary, floor binary").join(nodes.select("route", "node"), "route")
        sent = sent.select("node", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in fields.split(", ")), "q_width", "q_ids", "q", "floor")
        own = nodes.select("node", *columns, F.lit(None).cast("int").alias("q_width"), *(F.lit(None).cast("binary").alias(c) for c in ("q_ids", "q", "floor")))
        # A node's own row comes first, then the blocks that visit it.
        stream = own.unionByName(sent).repartition("node").sortWithinPartitions("node", F.col("q").isNotNull())
        return best(stream.mapInPandas(run, "query_id long, vec_id long, score long"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    early = written(visited(asked, True), "early-hits")
    tighter = early.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    again = asked.join(tighter, "vec_id", "left").select("vec_id", "v", F.greatest("floor", F.coalesce("reached", "floor")).alias("floor"))
    hits = early.drop("rank").unionByName(visited(again, False).drop("rank"))
    return best(hits).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth row of ``embeddings``."""
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_exact_top_k": op6_exact_top_k}
ORACLE = {
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
