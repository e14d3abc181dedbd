"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A sequence is filled greedily, always with the longest piece that still fits. If a gap stays, the
sequence's smallest piece is taken out again and replaced by the two unpacked pieces that together fill
the widened gap most tightly. All choices depend on lengths alone, so the packer works on the histogram of
lengths (at most ``capacity`` numbers, whatever the size of the corpus): the same choice repeats until one
of its lengths runs out, which makes a pattern with a number of repeats. Pieces then find their places by
their rank among the pieces of their length. Ranks are counted within salted groups, so a length that
holds a third of all pieces is spread over all tasks.

Defined cases: a null or empty text is its terminator alone; only documents over the capacity are cut, and
nothing is dropped; null ids and repeated rows are packed like any others; an empty table gives an empty
result; only the id and text columns are read, so further columns can have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionframe.llm._common import long_id, table, text_id, written
from motionframe.llm.tokenizing import default_path, worker_tokenizer

CAPACITY = 2048
LEAST_SALTS = 32


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, terminator: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]); ``ids`` are little-endian unsigned 32-bit numbers."""
    end = terminator.to_bytes(4, "little")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = worker_tokenizer(path)
        for f in frames:
            rows: list[tuple] = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                ids = words.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=columns)

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return long_id(docs.select(text_id("doc_id"), "text").mapInPandas(run, schema), "doc_id")


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats) by best-two-fit; uses up ``counts``."""
    left = {x: c for x, c in counts.items() if c > 0}
    sizes = sorted(left)
    made: list[tuple[tuple[int, ...], int]] = []
    while sizes:
        used: Counter[int] = Counter()
        gap, top = capacity, len(sizes)
        while (top := bisect_right(sizes, gap, 0, top)) > 0:
            x = sizes[top - 1]
            take = min(left[x] - used[x], gap // x)
            used[x] += take
            gap -= take * x
            top -= take == 0 or used[x] == left[x]
        if gap and len(used) + max(used.values()) > 2:
            small = min(used)
            pair = _tightest_pair(sizes, left, used, small, small + gap)
            if pair:
                used[small] -= 1
                used.update(pair)
        used = +used
        repeats = min(left[x] // m for x, m in used.items())
        made.append((tuple(sorted(used.elements(), reverse=True)), repeats))
        for x, m in used.items():
            left[x] -= m * repeats
            if not left[x]:
                del left[x]
        sizes = [x for x in sizes if x in left]
    return made


def _tightest_pair(sizes: list[int], left: dict[int, int], used: Counter[int], small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces with the greatest sum over ``small`` and up to ``room``."""
    free = [x for x in sizes if left[x] > used[x]]
    lo, hi, best, pair = 0, bisect_right(free, room) - 1, small, None
    while lo <= hi:
        total = free[lo] + free[hi]
        if total > room:
            hi -= 1
            continue
        if total > best and (lo < hi or left[free[lo]] - used[free[lo]] > 1):
            best, pair = total, (free[lo], free[hi])
        lo += 1
    return pair


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(length, first rank, rank after the last, first sequence, offsets of that length in a sequence)."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for lengths, repeats in made:
        at, offsets = 0, {}
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.append((x, rank[x], rank[x] + len(places) * repeats, sequence, places))
            rank[x] += len(places) * repeats
        sequence += repeats
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs doc_id, piece, length, and reads its input twice."""
    spark = pieces.sparkSession
    salts = max(LEAST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = slots(patterns(counts, capacity))
    schema = T.StructType([T.StructField("__length", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("__lo", "__hi", "__first")), T.StructField("__places", T.ArrayType(T.LongType()))])
    places = spark.createDataFrame(where, schema)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    ranked = ranked.join(starts, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # The slot table is bounded by the capacity (distinct lengths times patterns), not by the corpus.
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    turn, each = F.col("__rank") - F.col("__lo"), F.size("__places")
    found = found.withColumns({"sequence_id": (F.col("__first") + F.floor(turn / each)).cast("long"), "offset": F.get("__places", F.pmod(turn, each).cast("int"))})
    return found.select(*pieces.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, segments) of packed pieces that carry ``ids``; a group holds one sequence's pieces only."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("segments"))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places; texts are tokenized once, then only the stored pieces are read."""
    return pack(written(tokenized_pieces(docs, path or default_path(), capacity, with_ids=with_ids), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of ``documents`` in sequences of 2048 ids."""
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE: dict[str, str] = {}
