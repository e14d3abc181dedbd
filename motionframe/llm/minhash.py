"""MinHash near-duplicates with sequential Bayesian verification, and the connected groups they form.

1. Texts become sets of hashed word shingles; equal sets collapse to one node (their copies are never
   paired with each other).
2. Signatures are cut into bands; nodes that share a band's key are candidates. In every bucket each
   node is compared with one leader (the node with most copies), never with all others.
3. Candidates are verified in batches of signature positions: a pair is dropped as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold falls under ``miss``. Survivors
   are confirmed by the exact intersection of their full sets.
4. Links give components. Buckets that still hold several components are compared across components
   only, in blocks of bounded size, and give back a spanning forest of their links. Pairs inside a
   component are never made, for they can't change the result.

Bands: 30 of 5 rows miss a pair of similarity 0.8 with probability 7e-6; there is no cap on buckets. Buckets of
more than a block of unjoined nodes are dealt out by 37 bands of 4 positions that lie apart, which miss a pair
of the bucket with probability 4e-9, whatever its size.

Defined cases: null, empty and blank texts have no set and are linked with nothing (they stand alone);
rows without an id take no part (component null, kept); repeated rows have equal sets and fall in one
group; ties need no rule, for a group is named by its smallest id; an empty table gives an empty result.
Only the id and text columns are read, so further columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import long_id, release, table, text_id, written

BANDS, ROWS, BATCH = 30, 5, 30
POSITIONS = BANDS * ROWS
BLOCK = 1024
PAIRS_AT_ONCE = 100_000
CHUNK = 1024
MISS = 1e-5
CACHED_WORDS = 200_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


#: Odd multipliers, one for each position.
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    v = w[:n].copy()
    for k in range(1, size):
        v ^= v >> np.uint64(29)
        v = v * _M1 + w[k : k + n]
    v ^= v >> np.uint64(32)
    v *= _M2
    v ^= v >> np.uint64(29)
    return np.unique(v)


def signature(members: np.ndarray) -> np.ndarray:
    low = (members >> np.uint64(16)).astype(np.uint32)
    best = None
    for at in range(0, len(low), CHUNK):
        least = (low[at : at + CHUNK, None] * _MULTIPLIERS).min(0)
        best = least if best is None else np.minimum(best, least)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * _M1 + rows[:, k]
    key = (key ^ (key >> np.uint64(32))) * _M2
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def spread_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of 37 bands of 4 positions for each row of ``sig``; no two positions of a band are in the same one of ``band_keys``."""
    bands = POSITIONS // 4
    rows = sig[:, : 4 * bands].reshape(len(sig), 4, bands).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1)) << np.uint64(32)
    for k in range(4):
        key = (key ^ (key >> np.uint64(31))) * _M1 + rows[:, k]
    key = (key ^ (key >> np.uint64(32))) * _M2
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared positions, the fewest matches that don't rule a pair out.

    With a uniform prior, similarity given m matches of n is Beta(m+1, n-m+1), and its mass above t is
    the chance of at most m successes in n+1 trials of chance t.
    """
    t, least = percent / 100, []
    for n in range(BATCH, POSITIONS + 1, BATCH):
        total, p, m = 0.0, (1 - t) ** (n + 1), 0
        while total + p < miss and m <= n:
            total += p
            p *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        least.append(m)
    return tuple(least)


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions into ``i`` and ``j`` that survive all batches, and their matches; a bounded number of pairs at a time."""
    at, counts = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        alive = np.arange(lo, min(lo + PAIRS_AT_ONCE, len(i)))
        matches = np.zeros(len(alive), np.int32)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (left[i[alive], part] == right[j[alive], part]).sum(1, dtype=np.int32)
            ok = matches >= need
            alive, matches = alive[ok], matches[ok]
        at.append(alive)
        counts.append(matches)
    return np.concatenate(at), np.concatenate(counts)


def _prepared(docs: DataFrame, size: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHash()
        for f in frames:
            out: list[tuple] = []
            for doc, text in zip(f["doc_id"], f["__text"], strict=True):
                s = shingle_set(text, size, hashes)
                if len(s):
                    sig = signature(s)
                    out.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype("<u2").tobytes(), band_keys(sig).tolist()))
                else:
                    out.append((doc, 0, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_id", "sig", "bands"])

    return long_id(docs.select(text_id("doc_id"), "__text").mapInPandas(run, "doc_id string, n_shingles long, set_id binary, sig binary, bands array<long>"), "doc_id")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of ``nodes`` (nid, set_id, min_doc), made again from the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHash()
        for f in frames:
            out = []
            for nid, want, text in zip(f["nid"], f["set_id"], f["__text"], strict=True):
                s = shingle_set(text, size, hashes)
                if xxhash.xxh3_128_digest(s.tobytes()) == bytes(want):  # else another row that bears the same id
                    out.append((nid, s.tobytes()))
            yield pd.DataFrame(out, columns=["nid", "members"])

    texts = docs.join(nodes.select("nid", "set_id", F.col("min_doc").alias("doc_id")), "doc_id")
    return texts.select("nid", "set_id", "__text").mapInPandas(run, "nid long, members binary")


def _bayes(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    least = least_matches(percent)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        keep = np.zeros(len(a), bool)
        if len(a):
            left, right = (np.frombuffer(b"".join(map(bytes, x)), "<u2").reshape(len(x), POSITIONS) for x in (a, b))
            every = np.arange(len(a))
            keep[survivors(left, right, every, every, least)[0]] = True
        return pd.Series(keep)

    left, right = (sigs.select(F.col("nid").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(passes("sig_a", "sig_b")).select("a", "b")


def similar(small: np.ndarray, large: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, in whole numbers."""
    if len(small) > len(large):
        small, large = large, small
    if 100 * len(small) < percent * len(large):
        return False
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[spot] == small).sum())
    return 100 * common >= percent * (len(small) + len(large) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(bytes(x), np.uint64), np.frombuffer(bytes(y), np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    left, right = (sets.select(F.col("nid").alias(c), F.col("members").alias(f"members_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(linked("members_a", "members_b")).select("a", "b")


def connected(links: DataFrame) -> DataFrame:
    """(nid, comp) of the nodes in ``links`` (a, b): the smallest node of each component, by min-label steps with pointer jumping.

    Each step is stored, so a lost executor doesn't restart the loop. Hubs are joined, never collected.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("nid")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("nid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "nid").select("nid", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("nid").alias("to"), F.col("comp").alias("further"))
        fresh = written(step.join(jump, "to").select("nid", F.least("to", "further").alias("comp"), "was"), "labels")
        release(labels)
        labels = fresh.select("nid", "comp")
        if fresh.where(F.col("comp") != F.col("was")).isEmpty():
            release(edges)
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: components are contracted, joined, and the old labels mapped."""

    def top(c: str) -> DataFrame:
        return labels.select(F.col("nid").alias(c), F.col("comp").alias(f"comp_{c}"))

    over = links.join(top("a"), "a", "left").join(top("b"), "b", "left")
    over = over.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b")
    up = connected(over).select(F.col("nid").alias("old"), F.col("comp").alias("new"))
    moved = labels.join(up, F.col("comp") == F.col("old"), "left").select("nid", F.coalesce("new", "comp").alias("comp"))
    alone = up.select(F.col("old").alias("nid"), F.col("new").alias("comp")).join(labels, "nid", "left_anti")
    return written(moved.unionByName(alone), "merged")


def _grouped(frames: Iterator[pd.DataFrame], found) -> Iterator[pd.DataFrame]:
    """Results of ``found`` for every run of rows with equal (key, bi, bj); rows come sorted, a group may span batches."""

    def split(f: pd.DataFrame, whole: bool) -> tuple[list[pd.DataFrame], pd.DataFrame]:
        ids = f[["key", "bi", "bj"]].to_numpy()
        cuts = (np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist()
        bounds = [0, *cuts, len(f)] if whole else [0, *cuts]
        comp, own = f["comp"].to_numpy(), f["own"].to_numpy()
        sig = np.frombuffer(b"".join(map(bytes, f["sig"])), "<u2").reshape(len(f), POSITIONS)
        got = []
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1 and comp[s:e].min() < comp[s:e].max():
                if ids[s, 1] == ids[s, 2]:
                    i, j = np.triu_indices(e - s, 1)
                else:
                    first, second = np.flatnonzero(own[s:e] == ids[s, 1]), np.flatnonzero(own[s:e] == ids[s, 2])
                    i, j = np.repeat(first, len(second)), np.tile(second, len(first))
                differ = comp[s:e][i] != comp[s:e][j]
                if (out := found(f.iloc[s:e], sig[s:e], i[differ], j[differ])) is not None:
                    got.append(out)
        return got, f.iloc[bounds[-1] :]

    rest = None
    for f in frames:
        f = pd.concat([rest, f]) if rest is not None and len(rest) else f
        if len(f):
            got, rest = split(f, False)
            yield from got
    if rest is not None and len(rest):
        yield from split(rest, True)[0]


def _mixed(tagged: DataFrame) -> DataFrame:
    """(key, m, most, main) of the buckets with several components: all rows, rows of the largest one, its name."""
    sizes = tagged.groupBy("key", "comp").agg(F.count("*").alias("c"))
    found = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("comp", "c").alias("main"), F.count("*").alias("comps"))
    return found.where("comps > 1").drop("comps")


def _across(buckets: DataFrame, labels: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, enough to join all that any pair links.

    In a bucket, only the nodes outside its largest component have to meet others, so a group of near copies
    whose members mostly joined already costs rows in proportion to its size. Where more than a block stays
    outside (a passage that many unlike texts share), the bucket's nodes are dealt out again by ``spread_keys``.
    What is left is cut into blocks, and every two blocks of a bucket that can hold a link are compared once.
    A first pass over signatures leaves the nodes that have a surviving pair at all; with their full sets, a
    second pass confirms pairs, the likeliest first, and skips those that confirmed links already join. It
    returns a spanning forest of each block pair, so its rows grow with the nodes and not with the pairs.
    """

    @F.pandas_udf("array<long>")
    def spread(sig: pd.Series) -> pd.Series:
        if not len(sig):
            return pd.Series([], dtype=object)
        return pd.Series(list(spread_keys(np.frombuffer(b"".join(map(bytes, sig)), "<u2").reshape(len(sig), POSITIONS))))

    least = least_matches(percent)
    tagged = buckets.join(labels, "nid", "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp"))
    mixed = written(_mixed(tagged), "mixed")
    rows, wide = tagged.join(mixed, "key"), F.col("m") - F.col("most") > BLOCK
    if not mixed.where(wide).isEmpty():
        again = rows.where(wide).select("nid", "comp").distinct().join(sigs, "nid")
        again = written(again.select(F.explode(spread("sig")).alias("key"), "nid", "comp"), "spread-bands")
        rows = rows.where(~wide).unionByName(again.join(_mixed(again), "key"))
    # Blocks 0 to few - 1 hold the nodes outside the largest component, the others those in it.
    few, many = (F.ceil(c / BLOCK).cast("int") for c in (F.col("m") - F.col("most"), F.col("most")))
    inside = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("nid"), F.when(inside, many).otherwise(few)).cast("int") + F.when(inside, few).otherwise(F.lit(0))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, few).otherwise(few + many) - 1)))
    rows = rows.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "nid", "comp")

    def alive(f: pd.DataFrame, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame | None:
        at, _ = survivors(sig, sig, i, j, least)
        return f.iloc[np.unique(np.concatenate([i[at], j[at]]))][["key", "bi", "bj", "own", "nid", "comp"]] if len(at) else None

    def forest(f: pd.DataFrame, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame | None:
        at, matches = survivors(sig, sig, i, j, least)
        nid, comp = f["nid"].tolist(), f["comp"].tolist()
        members = [np.frombuffer(bytes(m), np.uint64) for m in f["members"]]
        up = {c: c for c in comp}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        links = []
        for k in np.argsort(-matches, kind="stable"):
            x, y = int(i[at[k]]), int(j[at[k]])
            if (p := root(comp[x])) != (q := root(comp[y])):
                if similar(members[x], members[y], percent):
                    up[p] = q
                    links.append((nid[x], nid[y]))
        return pd.DataFrame(links, columns=["a", "b"]) if links else None

    keys = ("key", "bi", "bj")
    first = rows.join(sigs, "nid").repartition(*keys).sortWithinPartitions(*keys)
    some = first.mapInPandas(lambda frames: _grouped(frames, alive), "key long, bi int, bj int, own int, nid long, comp long")
    second = some.join(sigs, "nid").join(sets, "nid").repartition(*keys).sortWithinPartitions(*keys)
    return second.mapInPandas(lambda frames: _grouped(frames, forest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: ``component_id`` is the smallest id that links reach."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    prepared = written(_prepared(own, shingle), "prepared")
    some = prepared.where("set_id is not null and doc_id is not null")
    nodes = some.groupBy("set_id").agg(F.min("doc_id").alias("min_doc"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    sigs = nodes.select("nid", "sig")
    bands = nodes.select("nid", "copies", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.max_by("nid", "copies").alias("leader"), F.count("*").alias("m")).where("m > 1")
    buckets = written(bands.select("key", "nid").join(shared.select("key", "leader"), "key"), "buckets")
    sets = written(_sets(own, nodes.select("nid", "set_id", "min_doc").join(buckets.select("nid").distinct(), "nid", "left_semi"), shingle).dropDuplicates(["nid"]), "sets")
    kept = (buckets, sets)
    buckets, star = buckets.select("key", "nid"), buckets.where("nid <> leader").select(F.least("nid", "leader").alias("a"), F.greatest("nid", "leader").alias("b")).distinct()
    labels = connected(_confirmed(_bayes(star, sigs, percent), sets, percent))
    labels = _merged(labels, _across(buckets, labels, sigs, sets, percent))
    for done in kept:
        release(done)
    grouped = nodes.select("nid", "set_id", "min_doc", "copies").join(labels, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    names = grouped.groupBy("comp").agg(F.min("min_doc").alias("component_id"))
    renamed = grouped.join(names, "comp").where("copies > 1 or component_id <> min_doc").select("set_id", "component_id")
    out = prepared.select("doc_id", "n_shingles", "set_id").join(renamed, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, one for each.

    Rows are told apart by a key of their own, so that ids may repeat or be null: a row goes only if its own
    text belongs to a group that keeps another row. The smallest id stays, null ids last, of repeated ids the
    first by a hash of the text. Rows without words have no group; of those with an id, repeated rows stay once.
    """
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    groups = near_duplicates(keyed, shingle, percent, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id", "n_shingles")
    # The same id and text, for rows without words; a null id is like no other.
    wordless = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.concat_ws("-", F.lit("id"), F.sha2("text", 256)))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64("text"), F.col("__row"))
    rows = keyed.select("__row", order.alias("order"), F.col("doc_id").cast("long").alias("__id"), wordless.alias("wordless")).join(groups, "__row")
    some = F.col("n_shingles") > 0
    group = F.when(some | F.col("__id").isNull(), F.col("component_id")).otherwise(F.col("__id"))
    kept = rows.groupBy(group.alias("group"), F.when(~some, F.col("wordless")).alias("wordless")).agg(F.min("order").alias("first")).select(F.col("first.__row").alias("__row"))
    return keyed.join(kept, "__row", "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` with 2-word shingles and a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
#: All pairs that share a shingle, by exact sets, and the closure of their links.
ORACLE = {
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, w[i] || ' ' || coalesce(w[i + 1], '') AS g FROM p),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = d.doc_id""",
}
