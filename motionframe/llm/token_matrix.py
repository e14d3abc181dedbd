"""Token-id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Every task packs runs of its own rows (a run ends at ``run_tokens`` ids), so memory is bounded by a run and
hardly any text moves between executors. Rows that a run leaves open (more than ``OPEN`` of them free) are
taken apart and packed again in a second round, in runs of all tasks' leftovers together, so how full the
rows get doesn't depend on how the table is split; if that needs no fewer rows, the first round stands. Within a run pieces are placed from the longest to the shortest
into the open row with the least sufficient room, found by descending a segment tree whose leaves are the
possible free capacities. A result row is one matrix row: ``ids`` (fixed width, little-endian, padded),
``cu_seqlens`` (0 and the cumulative segment lengths), ``resets`` (where position ids start again at 0)
and the pieces it holds. Concatenated ``ids`` of any rows form an id matrix (``matrix``); ``save`` writes rows as Parquet, one id
matrix with its cumulative lengths and resets a file.

Documents over the capacity are cut without loss; ``rebuilt`` puts them together again. An id that doesn't
fit ``id_bytes`` is refused with an error.

Defined cases: a null or empty text is its terminator alone; null ids and repeated rows are packed like any
others; ties in length are placed in the order of the input; an empty table gives an empty result; only
the id and text columns are read, so further columns can have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import table, text_id, written
from motionframe.llm.tokenizing import default_path, worker_tokenizer

CAPACITY = 2048
RUN_TOKENS = 4_000_000
OPEN = 1 / 32


class CapacityTree:
    """Open rows by free capacity; each node knows how many rows lie below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, free: int, row: int) -> None:
        if free:
            self.rows[free].append(row)
            self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free capacity of ``need`` or more, removed from the tree."""
        node = need + self.leaves
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.counts[2 * node])
        free = node - self.leaves
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Indexes into ``lengths`` by row."""
    lengths = list(lengths)
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            found = capacity, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(i)
        tree.put(free - lengths[i], row)
    return rows


def id_matrix(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, terminator: int = 0, pad: int = 0, id_bytes: int = 2, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Matrix rows of all ``docs``; ``id_bytes`` 2 fits vocabularies of up to 65,536 ids."""
    path, kind = path or default_path(), f"<u{id_bytes}"
    end = terminator.to_bytes(4, "little")

    def packed(pieces: list[tuple]) -> pd.DataFrame:
        out = []
        for members in best_fit_decreasing((len(p[3]) for p in pieces), capacity):
            own = [pieces[i] for i in members]
            cuts = np.cumsum([0, *(len(p[3]) for p in own)])
            row = np.full(capacity, pad, kind)
            row[: cuts[-1]] = np.concatenate([p[3] for p in own])
            segments = [{"doc_id": p[0], "piece": p[1], "start": p[2]} for p in own]
            out.append((bool(capacity - cuts[-1] > OPEN * capacity), int(cuts[-1]), row.tobytes(), cuts.tolist(), cuts[:-1].tolist(), segments))
        return pd.DataFrame(out, columns=["open", "n_tokens", "ids", "cu_seqlens", "resets", "segments"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, tokens = worker_tokenizer(path), [], 0
        for f in frames:
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                ids = np.frombuffer(words.encode(text) + end, "<u4")
                if ids.max() >> (8 * id_bytes):
                    raise ValueError(f"id {ids.max()} doesn't fit {id_bytes} bytes")
                ids = ids.astype(kind)
                doc = None if pd.isna(doc) else int(doc)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    held.append((doc, k, at, ids[at : at + capacity]))
                tokens += len(ids)
                if tokens >= run_tokens:
                    yield packed(held)
                    held, tokens = [], 0
        if held:
            yield packed(held)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tokens = [], 0
        for f in frames:
            for doc, piece, start, raw in zip(f["doc_id"], f["piece"], f["start"], f["ids"], strict=True):
                held.append((None if pd.isna(doc) else int(doc), piece, start, np.frombuffer(raw, kind)))
                tokens += len(held[-1][3])
            if tokens >= run_tokens:
                yield packed(held)
                held, tokens = [], 0
        if held:
            yield packed(held)

    schema = "open boolean, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, segments array<struct<doc_id:long,piece:int,start:long>>"
    first = written(docs.select(text_id("doc_id"), "text").mapInPandas(run, schema), "matrix-rows")
    opened, tokens = first.where("open").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    left = _pieces(first.where("open"), id_bytes).withColumn("doc_id", F.col("doc_id").cast("string"))
    second = written(left.repartition(max(-(-tokens // run_tokens), 1)).mapInPandas(again, schema), "matrix-rows")
    # Long pieces without short ones to fill their gaps can't be packed better; then the first round stands.
    best = first.where("not open").unionByName(second) if second.count() < opened else first
    return best.drop("open").select(F.monotonically_increasing_id().alias("sequence_id"), "*")


def _pieces(sequences: DataFrame, id_bytes: int) -> DataFrame:
    """(doc_id, piece, start, ids) of the segments in matrix rows."""
    parts = sequences.select("ids", "cu_seqlens", F.posexplode("segments").alias("k", "s"))
    parts = parts.select("s.*", F.get("cu_seqlens", F.col("k")).alias("a"), F.get("cu_seqlens", F.col("k") + 1).alias("b"), "ids")
    return parts.select("doc_id", "piece", "start", F.substring(F.col("ids"), F.col("a") * id_bytes + 1, (F.col("b") - F.col("a")) * id_bytes).alias("ids"))


def save(sequences: DataFrame, folder: str) -> None:
    """Writes matrix rows: in every file, column ``ids`` is one packed id matrix."""
    sequences.select("sequence_id", "ids", "cu_seqlens", "resets", "segments").write.parquet(folder)


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of a matrix row: they count up and start again at 0 at every reset and in the padding."""
    cuts = [*cu_seqlens, capacity]
    return np.concatenate([np.arange(b - a) for a, b in zip(cuts, cuts[1:], strict=False)])


def matrix(rows: Iterable[bytes], id_bytes: int = 2) -> np.ndarray:
    rows = list(rows)
    return np.frombuffer(b"".join(rows), f"<u{id_bytes}").reshape(len(rows), -1)


def rebuilt(sequences: DataFrame, id_bytes: int = 2) -> DataFrame:
    """(doc_id, ids) again from matrix rows; a group holds one document's pieces."""
    whole = F.sort_array(F.collect_list(F.struct("piece", F.hex("ids").alias("h"))))
    return _pieces(sequences, id_bytes).groupBy("doc_id").agg(whole.alias("p")).select("doc_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("ids"))


def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix rows of all ``documents``."""
    return id_matrix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_matrix": op1_token_matrix}
ORACLE: dict[str, str] = {}
