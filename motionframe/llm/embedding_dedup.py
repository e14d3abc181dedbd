"""Embedding near-duplicates: int8 products of tiles with rigorous error bounds, full precision only where these leave doubt.

1. Equal vectors of a label collapse to one node with a number of copies. Vectors are scaled to length 1.
2. A unit vector x becomes int8 codes q and a scale s; its residual e = x - s q is measured in double
   precision. For two vectors |x.y - s t (q.r)| <= |e| + |f| + |e| |f|, plus a slack for rounding.
3. The nodes of a label are dealt to blocks of about ``BLOCK``; any two blocks of a label meet once as a tile.
   A tile multiplies codes (exact in float32, or in double beyond 1,040 components). A pair whose bounds lie
   on one side of the threshold is decided; a node that is part of an undecided pair is asked for.
4. Only the nodes that were asked for travel again, with their full vectors, to the tiles that asked; there
   undecided pairs are computed in double precision.
5. Tiles never return pairs, only each node's number of links and, for each piece that links join inside the
   tile, a star of its nodes. So rows grow with nodes and tiles. Stars give components.

The codes of a block travel once to each tile of its label: a label of n vectors costs n^2 / ``BLOCK`` rows
of codes, packed by block, which is what comparing all pairs asks for.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without
a label, link with nothing and stand alone; vectors of one label with unlike lengths don't link; repeated rows
are vectors of their own, linked with each other; rows without an id take no part (no links, component null,
kept); ties need no rule, for a group is named by its smallest id; an empty table gives an empty result; only
the three columns are read, so further columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import long_id, table, text_id, written
from motionframe.llm.minhash import connected

THRESHOLD, BLOCK = 0.93, 2048
#: Products of up to so many components of at most 127 stay whole in float32.
EXACT_IN_FLOAT = 2**24 // 127**2
SLACK = 1e-12
PAIRS_AT_ONCE = 100_000


def unit(x: np.ndarray) -> np.ndarray | None:
    """``x`` scaled to length 1; None if it is zero or isn't finite."""
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the residuals of unit rows."""
    scale = np.abs(x).max(1, initial=0) / 127
    codes = np.rint(x / np.maximum(scale, 1e-300)[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((x - scale[:, None] * codes) ** 2).sum(1))


def bounds(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of all rows of ``a`` and ``b``, and how far off each can be."""
    kind = np.float32 if a[0].shape[1] <= EXACT_IN_FLOAT else np.float64
    about = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64)
    about *= a[1][:, None] * b[1][None, :]
    off = a[2][:, None] + b[2][None, :] + a[2][:, None] * b[2][None, :] + SLACK * (1 + a[0].shape[1])
    return about, off


def _pieces(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A star (first, other) for each piece of a bipartite graph; every row of ``linked`` is visited once."""
    rows_left, seen_row, seen_col, out = np.flatnonzero(linked.any(1)), np.zeros(len(left), bool), np.zeros(len(right), bool), []
    for seed in rows_left:
        if seen_row[seed]:
            continue
        rows, found = np.array([seed]), []
        seen_row[seed] = True
        while len(rows):
            found.append(left[rows])
            cols = np.flatnonzero(linked[rows].any(0) & ~seen_col)
            seen_col[cols] = True
            found.append(right[cols])
            rows = np.flatnonzero(linked[:, cols].any(1) & ~seen_row)
            seen_row[rows] = True
        nodes = np.unique(np.concatenate(found))
        out += [(int(nodes[0]), int(n)) for n in nodes[1:]]
    return out


def _tile_rows(linked: np.ndarray, left: np.ndarray, right: np.ndarray, copies_left: np.ndarray, copies_right: np.ndarray, same: bool) -> list[tuple[int, int | None, int | None]]:
    """(a, b, n): numbers of linked vectors by node (b is null) and stars of pieces (n is null)."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return []
    part = linked[np.ix_(rows, cols)]
    out: list = [(int(n), None, int(c)) for n, c in zip(left[rows], part @ copies_right[cols], strict=True)]
    if not same:
        out += [(int(n), None, int(c)) for n, c in zip(right[cols], copies_left[rows] @ part, strict=True)]
    return out + [(a, b, None) for a, b in _pieces(part, left[rows], right[cols])]


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, set_id), and nodes (nid, set_id, label, width, copies, least_id, x) of equal vectors; ``x`` has unit length."""
    x = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.when(~F.exists(x, lambda c: c.isNull()), x.cast("array<double>")).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, label, x in zip(f["vec_id"], f["label"], f["x"], strict=True):
                v = unit(np.asarray(x, np.float64)) if x is not None and not pd.isna(label) and not pd.isna(i) else None
                # The components as they were decide which vectors are equal, with their label.
                key = None if v is None else xxhash.xxh3_128_digest(f"{len(v)}:{label}:".encode("utf-8", "surrogatepass") + np.asarray(x, "<f8").tobytes())
                out.append((i, key, label if key else None, len(v) if key else None, v.tobytes() if key else None))
            yield pd.DataFrame(out, columns=["vec_id", "set_id", "label", "width", "x"]).astype({"width": "Int32"})

    found = written(long_id(rows.select(text_id("vec_id"), "label", "x").mapInPandas(run, "vec_id string, set_id binary, label string, width int, x binary"), "vec_id"), "unit-vectors")
    nodes = found.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), *(F.first(c).alias(c) for c in ("label", "width", "x")))
    return found.select("vec_id", "set_id"), written(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def _blocks(nodes: DataFrame, block: int) -> DataFrame:
    """(label, width, blocks, own, nids, copies, codes, scales, errors): packed blocks of each label."""
    sizes = nodes.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # Coded before anything is shuffled: a byte a component and two numbers.
    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x in f["x"]:
                c, s, e = quantised(np.frombuffer(x)[None, :])
                rows.append((c.tobytes(), s[0], e[0]))
            yield pd.concat([f.drop(columns="x").reset_index(drop=True), pd.DataFrame(rows, columns=["codes", "scale", "error"])], axis=1)

    coded = nodes.select("nid", "copies", "label", "width", "x").mapInPandas(code, "nid long, copies long, label string, width int, codes binary, scale double, error double")
    dealt = coded.join(sizes, ["label", "width"]).withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("nid")
        one = f.iloc[0]
        return pd.DataFrame([(one["label"], one["width"], one["blocks"], one["own"], f["nid"].to_numpy("<i8").tobytes(), f["copies"].to_numpy("<i8").tobytes(), b"".join(map(bytes, f["codes"])), f["scale"].to_numpy("<f8").tobytes(), f["error"].to_numpy("<f8").tobytes())])

    return dealt.groupBy("label", "width", "own").applyInPandas(pack, "label string, width int, blocks int, own int, nids binary, copies binary, codes binary, scales binary, errors binary")


def tile_links(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links found in tiles as (a, b, n), see ``_tile_rows``: those that bounds decide, and those that full precision does."""
    packed = written(_blocks(nodes, block), "blocks")
    parts = ("nids", "copies", "codes", "scales", "errors")
    left = packed.withColumn("other", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    left = left.select("label", "width", F.col("own").alias("bi"), F.col("other").alias("bj"), *(F.col(c).alias(f"l_{c}") for c in parts))
    right = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own"))))
    right = right.select("label", "width", F.col("other").alias("bi"), F.col("own").alias("bj"), *(F.col(c).alias(f"r_{c}") for c in parts))
    keys = ("label", "width", "bi", "bj")

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in f.itertuples(index=False):
                side = []
                for s in "lr":
                    get = lambda c, kind="<f8", s=s: np.frombuffer(getattr(t, f"{s}_{c}"), kind)
                    side.append((get("nids", "<i8"), get("copies", "<i8"), (get("codes", np.int8).reshape(-1, t.width), get("scales"), get("errors"))))
                (a, a_copies, qa), (b, b_copies, qb) = side
                about, off = bounds(qa, qb)
                sure, open_ = about - off >= threshold, about + off >= threshold
                open_ &= ~sure
                if t.bi == t.bj:
                    np.fill_diagonal(sure, False)
                    np.fill_diagonal(open_, False)
                rows = [(x, y, n, None) for x, y, n in _tile_rows(sure, a, b, a_copies, b_copies, t.bi == t.bj)]
                rows += [(int(n), None, None, t.bi) for n in a[open_.any(1)]]
                if t.bi != t.bj:
                    rows += [(int(n), None, None, t.bj) for n in b[open_.any(0)]]
                if rows:
                    out = pd.DataFrame(rows, columns=["a", "b", "n", "own"]).astype({"b": "Int64", "n": "Int64", "own": "Int32"})
                    yield out.assign(label=t.label, width=t.width, bi=t.bi, bj=t.bj)

    tiles = left.join(right, list(keys))
    seen = written(tiles.mapInPandas(first, "a long, b long, n long, own int, label string, width int, bi int, bj int"), "tiles")
    asked = seen.where("own is not null").select(F.col("a").alias("nid"), "own", *keys).join(nodes.select("nid", "copies", "x"), "nid")

    def second(f: pd.DataFrame) -> pd.DataFrame:
        bi, bj, width = int(f["bi"].iloc[0]), int(f["bj"].iloc[0]), int(f["width"].iloc[0])
        side = []
        for own in (bi, bj):
            part = f[f["own"] == own]
            x = np.frombuffer(b"".join(map(bytes, part["x"]))).reshape(-1, width)
            side.append((part["nid"].to_numpy(np.int64), part["copies"].to_numpy(np.int64), x, quantised(x)))
        (a, a_copies, x, qx), (b, b_copies, y, qy) = side
        about, off = bounds(qx, qy)
        open_ = (about + off >= threshold) & (about - off < threshold)
        if bi == bj:
            np.fill_diagonal(open_, False)
        i, j = np.nonzero(open_)
        linked = np.zeros(open_.shape, bool)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            p, q = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            linked[p, q] = (x[p] * y[q]).sum(1) >= threshold
        return pd.DataFrame(_tile_rows(linked, a, b, a_copies, b_copies, bi == bj), columns=["a", "b", "n"]).astype({"b": "Int64", "n": "Int64"})

    return seen.where("own is null").select("a", "b", "n"), asked.groupBy(*keys).applyInPandas(second, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, nodes = _nodes(vectors, id_col, vector_col, label_col)
    sure, computed = tile_links(nodes, threshold, block)
    links = written(sure.unionByName(computed), "links")
    counts = links.where("n is not null").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("n"))
    labels = connected(links.where("b is not null").select("a", "b"))
    grouped = nodes.select("nid", "set_id", "least_id", "copies").join(counts, "nid", "left").join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    names = grouped.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    # Others stand alone, which needs no join.
    found = grouped.where("copies > 1 or n is not null").join(names, "comp").select("set_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(found, "set_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all ``embeddings`` by label at a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
#: All pairs of a label in double precision, and the closure of their links.
ORACLE = {
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT x.i AS a, y.i AS b FROM u x JOIN u y ON x.label = y.label AND x.i <> y.i AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.len * y.len) >= 0.93),
        reach AS (SELECT a, b FROM links UNION SELECT reach.a, l.b FROM reach JOIN links l ON reach.b = l.a),
        low AS (SELECT a, min(vec_id) AS m FROM reach JOIN v ON v.i = b GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, coalesce(vec_id = least(vec_id, m), true) AS kept
        FROM v LEFT JOIN n ON n.a = i LEFT JOIN low ON low.a = i""",
}
