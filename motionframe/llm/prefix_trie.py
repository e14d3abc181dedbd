"""Prefix trie of rebuilt conversations, merged inside families before anything global is shuffled.

A family is a base conversation and those that take their first turns from it. Turns become digests and byte
lengths where they are read; texts are never shuffled. Families are grouped by their base and streamed level
by level: the state is one chained 128-bit digest for each conversation of the family (at most nine), so a
long conversation costs no memory. Conversations of a family that share a prefix leave one combined node.
Combined nodes are then merged over all families by their digest.

Sums over subtrees need no walk of the tree. Every node belongs to the chain of its smallest member; the nodes
of one chain are the end of that conversation's path. A subtree holds the whole chains of its members, apart
from what its own chain has above its top. So a node's sum is the sum of its members' chain totals less a
running sum of its own chain: rows in proportion to the turns, however deep the trie.

Defined cases: a null role or text is empty; turns go by number, nulls first, ties by the digest of role and
text; repeated rows are turns of their own; rows without a conversation id take no part; ``%`` keeps the sign
(the base of -3 is 0); an id that isn't there has no turns, so families without a base, empty texts and very
long ones need no rule; an empty table has no nodes, not even the root; only the four columns are read, so
further columns can have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.llm._common import table, written

FAMILY, SHARED = 5, 9
ROOT = bytes(16)
#: Ids of one end node are joined inside ranges of so many ids before they meet; ids are distinct, so that bounds a group.
END_RANGE = 4096


def family_turns(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(base, conv_id, depth, shared, last, digest, bytes): each conversation's own rebuilt turns, and at depth 0 one row that says how many turns it takes from its base and where it ends."""
    turn = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    slim = own.select((F.col("conv_id") - F.col("conv_id") % family).alias("base"), "conv_id", "turn", F.substring(F.unhex(F.sha2(turn, 256)), 1, 16).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    conv = Window.partitionBy("base", "conv_id")
    is_base = F.col("conv_id") == F.col("base")
    ranked = slim.repartition("base").withColumns({"rank": F.row_number().over(conv.orderBy("turn", "digest")), "n": F.count("*").over(conv)})
    # A base takes nothing from itself: its own turns are the rebuilt ones.
    ranked = ranked.withColumn("most", F.when(is_base, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % shared))
    base_turns = F.coalesce(F.max(F.when(is_base, F.col("n"))).over(Window.partitionBy("base")), F.lit(0))
    ranked = ranked.withColumn("shared", F.least("most", base_turns))
    depth = F.col("shared") + F.col("rank") - F.col("most")
    last = F.col("shared") + F.greatest(F.col("n") - F.col("most"), F.lit(0))
    first, later = F.col("rank") == 1, F.col("rank") > F.col("most")
    depths = F.array_compact(F.array(F.when(first, F.lit(0).cast("long")), F.when(later, depth.cast("long"))))
    out = ranked.select("base", "conv_id", F.explode(depths).alias("depth"), "shared", last.alias("last"), "digest", "bytes")
    return out.sortWithinPartitions("base", "depth", "conv_id")


def _level(base: int, depth: int, rows: list[tuple], paths: dict[int, tuple[int, int, bytes]]) -> list[tuple]:
    """Combined nodes (depth, node, parent, bytes, members, ends) of one level of a family; ``paths`` has (shared, last, digest) of each conversation."""
    own = {conv: (digest, size) for conv, _, _, digest, size in rows}
    found: dict[bytes, tuple] = {}
    for conv, (shared, last, parent) in paths.items():
        if depth <= last:
            digest, size = own[base if depth <= shared else conv]
            node = hashlib.blake2b(parent + digest, digest_size=16).digest()
            paths[conv] = (shared, last, node)
            _, _, _, _, members, ends = found.setdefault(node, (depth, node, parent, size, [], []))
            members.append(conv)
            if depth == last:
                ends.append(conv)
    return list(found.values())


def family_nodes(turns: DataFrame) -> DataFrame:
    """(depth, node, parent, bytes, members, ends) of every family's own trie; ``turns`` come sorted by base, depth and conversation."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, paths = None, [], {}

        def level() -> list[tuple]:
            nonlocal paths
            base, depth = key
            if depth == 0:
                paths = {conv: (shared, last, ROOT) for conv, shared, last, _, _ in rows}
                return [(0, ROOT, None, 0, list(paths), [conv for conv, (_, last, _) in paths.items() if last == 0])]
            return _level(base, depth, rows, paths)

        for f in frames:
            out: list[tuple] = []
            for base, depth, *row in zip(f["base"], f["depth"], f["conv_id"], f["shared"], f["last"], f["digest"], f["bytes"], strict=True):
                if (base, depth) != key:
                    if key is not None:
                        out += level()
                    key, rows = (base, depth), []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=columns)
        if key is not None:
            yield pd.DataFrame(level(), columns=columns)

    columns = ["depth", "node", "parent", "bytes", "members", "ends"]
    return turns.mapInPandas(run, "depth long, node binary, parent binary, bytes long, members array<long>, ends array<long>")


def _end_hashes(combined: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: ids are joined inside ranges of ids, then hashed range by range."""
    ends = combined.select("node", F.explode("ends").alias("conv_id"))
    spans = ends.groupBy("node", F.floor(F.col("conv_id") / END_RANGE).alias("span")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    order = spans.repartition("node").sortWithinPartitions("node", "span")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, hashlib.sha256()
        for f in frames:
            out = []
            for own, ids in zip(f["node"], f["ids"], strict=True):
                if own != node:
                    if node is not None:
                        out.append((node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "ends_sha256"])

    return order.select("node", "ids").mapInPandas(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    combined = written(family_nodes(family_turns(conversations, family, shared)), "family-nodes")
    merged = combined.groupBy("node").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).cast("long").alias("n_convs"))
    merged = written(merged, "nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = merged.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": saved})
    nodes = nodes.withColumn("above", F.coalesce(F.sum("saved").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = written(nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "saved", "above"), "nodes")
    # Stored, so that joins by member and by parent have plain shuffles on both sides and skewed keys can be split.
    chains = written(nodes.groupBy("conv_id").agg(F.sum("saved").alias("whole"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "chains")
    members = combined.select("node", F.explode("members").alias("conv_id")).join(chains, "conv_id")
    sums = members.groupBy("node").agg(F.sum("whole").alias("whole"), F.sum("leaf").alias("n_leaves"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "parent", "left").join(sums, "node").join(_end_hashes(combined), "node", "left")
    saved_tokens = F.col("whole") - F.col("above")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved_tokens.alias("saved_tokens"), ends.alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt ``conversations``."""
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
#: Prefixes as joined digests, subtrees as prefixes of prefixes; CRC-32 bit by bit.
ORACLE = {
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r,
                md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda h, b: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)), xor(h, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM t),
        own AS (SELECT c, 0 AS part, r, g, bytes FROM c JOIN t ON t.conv_id = base WHERE r <= h UNION ALL SELECT c, 1, r, g, bytes FROM c JOIN t ON t.conv_id = c WHERE r > h),
        re AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, r) AS d, g, bytes FROM own),
        p AS (SELECT c, d, bytes, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS k, count(*) OVER (PARTITION BY c) AS last FROM re
              UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM re WHERE re.c = c.c) FROM c),
        n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256 FROM p GROUP BY k, d),
        ch AS (SELECT n.k, count(u.k) AS n_children FROM n LEFT JOIN n u ON u.d = n.d + 1 AND left(u.k, 32 * n.d) = n.k GROUP BY n.k),
        m AS (SELECT n.*, n_children FROM n JOIN ch USING (k)),
        s AS (SELECT m.k, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum(u.saved) AS BIGINT) AS saved_tokens FROM m JOIN m u ON u.d >= m.d AND left(u.k, 32 * m.d) = m.k GROUP BY m.k)
        SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN s USING (k) LEFT JOIN n up ON up.d = m.d - 1 AND up.k = left(m.k, 32 * (m.d - 1))""",
}
