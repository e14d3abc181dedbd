"""SentencePiece encoding and decoding with a relational lattice.

A text becomes segments: a run of escaped spaces with the word after it. No piece of the vocabulary crosses
a segment's border (``pieces`` checks that), so a text's ids are its segments' ids in a row. Every segment,
frequent or rare, short or long, is encoded by its lattice: all substrings of at most the longest piece are
equi-joined with the piece table, the edges are grouped by word, and a fold picks the path.

* ``viterbi`` folds the path with the greatest sum of scores, by Spark's higher-order ``aggregate`` over the
  edges of ``lattice``, a Spark join. It is right for unigram tables.
* ``encode`` is for byte-pair models, as the shipped vocabulary is: their scores are merge ranks, and the path
  with the greatest sum isn't what such a model encodes. Its fold takes the best-scored edge that joins two
  neighbouring symbols, leftmost first among equals, until none is left, which equals the library's result.
  Words are folded side by side as arrays, inside the task that holds the texts: the same lattice as Spark
  rows would shuffle some forty edges for each of millions of distinct words.

A word is cut where no edge crosses a place, since no merge can cross it either. What lies between two such
cuts is folded as a 64-bit mask of symbol borders, or, if it is longer than the mask, by the same rule with a
heap.

Defined cases: null and empty texts have no ids; characters without a piece become byte pieces; null ids and
repeated rows are encoded like any others; ties between edges go to the left; texts and words of any length
are encoded whole, words in slices of bounded size; an empty table gives an empty result; only the id and
text columns are read, so further columns can have any names.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionframe.llm._common import let, long_id, table, text_id

SPACE = "▁"
#: Words that a worker remembers and their characters, characters of words that are folded side by side, and of texts that are cut at a time.
CACHED, HELD, SLICE, CUT = 200_000, 2_000_000, 150_000, 1_000_000
#: Borders that fit a mask.
MASK = 63
FILTER_BITS = 20
SEGMENT = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    """Normal pieces with (score, id), byte ids by byte, and all pieces by id."""

    normal: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    by_id: tuple[str, ...]
    longest: int


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str | None = None) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    names = tuple(model.id_to_piece(i) for i in range(model.get_piece_size()))
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
    normal = {p: (model.get_score(i), i) for i, p in enumerate(names) if not special[i]}
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece crosses a word border; segments of this vocabulary can't be encoded one by one")
    return Pieces(normal, tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)), names, max(map(len, normal)))


def piece_table(spark: SparkSession, known: Pieces) -> DataFrame:
    rows = [(p, i, float(s)) for p, (s, i) in known.normal.items()]
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), schema)


def escaped(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))).otherwise(F.lit(""))


def segments(text: Column) -> Column:
    """Segments of a text as an array; empty for null and empty texts."""
    cut = F.split(escaped(F.coalesce(text, F.lit(""))), f"(?<=[^{SPACE}])(?={SPACE})")
    return F.array_remove(cut, "")


def lattice(words: DataFrame, table_: DataFrame, longest: int) -> DataFrame:
    """(seg, edges) with edges as (score, start, end, id) for every substring of ``seg`` that is a piece."""
    n = F.length("seg")
    starts = words.select("seg", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("seg", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.length("seg"), F.col("start") + longest))).alias("end"))
    cut = spans.withColumn("piece", F.substring(F.col("seg"), F.col("start") + 1, F.col("end") - F.col("start")))
    # The vocabulary's table has a fixed size.
    edges = cut.join(F.broadcast(table_), "piece")
    grouped = edges.groupBy("seg").agg(F.collect_list(F.struct("score", "start", "end", "id")).alias("edges"))
    return words.join(grouped, "seg", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<score:double,start:int,end:int,id:int>>")))


def _spelled(seg: Column, cuts: Column, edges: Column) -> Column:
    """Ids between neighbouring cuts: a piece's, or minus one minus the code point of a character without one."""

    def one(i: Column) -> Column:
        a, b = F.get(cuts, i), F.get(cuts, i + 1)
        hit = F.filter(edges, lambda e: (e["start"] == a) & (e["end"] == b))
        return F.coalesce(F.get(hit, F.lit(0))["id"], -1 - F.ascii(F.substring(seg, a + 1, F.lit(1))))

    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), one)


def viterbi(seg: Column, edges: Column, unknown: float = -100.0) -> Column:
    """Unigram fold: for each position the best score and its cuts; a character without a piece costs ``unknown``. Ties go to the longer last piece."""
    kind = "array<struct<score:double,cuts:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("cuts"))).cast(kind)

    def step(best: Column, end: Column) -> Column:
        into = F.array_sort(F.filter(edges, lambda e: e["end"] == end), lambda x, y: x["start"] - y["start"])
        by_piece = F.transform(into, lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start")))
        alone = F.struct((F.get(best, end - 1)["score"] + unknown).alias("score"), (end - 1).alias("start"))
        pick = F.array_max(F.transform(F.concat(by_piece, F.array(alone)), lambda c: F.struct(c["score"].alias("score"), (-c["start"]).alias("back"))))
        found = let(pick, lambda p: F.struct(p["score"].alias("score"), F.concat(F.get(best, -p["back"])["cuts"], F.array(end)).alias("cuts")))
        return F.concat(best, F.array(found)).cast(kind)

    best = F.aggregate(F.sequence(F.lit(1), F.length(seg)), first, step)
    return let(F.element_at(best, -1)["cuts"], lambda c: _spelled(seg, c, edges))


class Lattice(dict):
    """Ids of words (as little-endian 32-bit numbers) by the lattice of the piece table, for many words at once; a dictionary of words met so far."""

    def __init__(self, normal: dict[str, tuple[float, int]], byte_ids: tuple[int, ...], longest: int):
        super().__init__()
        self.normal, self.byte_ids, self.longest, self.chars = normal, byte_ids, longest, 0
        self.by_length = []
        for k in range(1, longest + 1):
            own = [p for p in normal if len(p) == k]
            chars = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, k)
            keys = self._keys(chars[:, 0].astype(np.uint64), (chars[:, c] for c in range(1, k)))
            order = np.argsort(keys)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.by_length.append((keys[order], chars[order], np.array([normal[own[i]][0] for i in order]), np.array([normal[own[i]][1] for i in order], np.int64), seen))

    @staticmethod
    def _grown(keys: np.ndarray, chars: np.ndarray) -> np.ndarray:
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return keys + chars

    def _keys(self, keys: np.ndarray, columns) -> np.ndarray:
        keys = self._grown(keys, np.uint64(1))
        for c in columns:
            keys = self._grown(keys, c)
        return keys

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, score, id) of all pieces among the substrings of words; ``ends`` is the end of each character's word."""
        at, keys, found = np.arange(len(chars)), self._keys(chars.astype(np.uint64), ()), []
        for k, (known, spelled, scores, ids, seen) in enumerate(self.by_length, 1):
            if k > 1:
                inside = at + k <= ends[at]
                at, keys = at[inside], keys[inside]
                keys = self._grown(keys, chars[at + k - 1])
            if not len(at):
                break
            if not len(known):
                continue
            maybe = np.flatnonzero(seen[keys >> np.uint64(64 - FILTER_BITS)])
            spot = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
            hit = known[spot] == keys[maybe]
            start, spot = at[maybe[hit]], spot[hit]
            same = (chars[start[:, None] + np.arange(k)] == spelled[spot]).all(1)
            start, spot = start[same], spot[same]
            found.append((start, np.full(len(start), k), scores[spot], ids[spot]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 4

    def borders(self, text: str, chars: np.ndarray, first: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether a symbol begins at each character after all merges; ``first`` marks where words begin."""
        start, length, score, _ = (x[edges[1] > 1] for x in edges)
        n = len(chars)
        crossed = np.zeros(n + 2, np.int64)
        np.add.at(crossed, start + 1, 1)
        np.add.at(crossed, start + length, -1)
        cut = (np.cumsum(crossed)[:n] == 0) | first
        units = np.flatnonzero(cut)
        unit = np.cumsum(cut) - 1
        sizes = np.diff(np.append(units, n))
        border = np.ones(n, bool)
        for u in np.flatnonzero(sizes > MASK):
            border[units[u] : units[u] + sizes[u]] = self.by_heap(text[units[u] : units[u] + sizes[u]])
        fits = sizes[unit[start]] <= MASK
        start, length, score = start[fits], length[fits], score[fits]
        own = unit[start]
        order = np.lexsort((start, -score, own))
        own, length = own[order], length[order].astype(np.uint64)
        left, one = (start[order] - units[own]).astype(np.uint64), np.uint64(1)
        ends = (one << left) | (one << (left + length))
        inner = (one << (left + length)) - (one << (left + one))
        mask = np.full(len(units), np.uint64(2**64 - 1))
        while len(own):
            have = mask[own]
            alive = (have & ends) == ends
            between = np.bitwise_count(have & inner)
            fit = np.flatnonzero(alive & (between == 1))
            if not len(fit):
                break
            best = fit[np.append(True, own[fit[1:]] != own[fit[:-1]])]
            mask[own[best]] &= ~inner[best]
            going = np.zeros(len(units), bool)
            going[own[best]] = True
            keep = alive & (between > 0) & going[own]
            keep[best] = False
            own, ends, inner = own[keep], ends[keep], inner[keep]
        short = sizes[unit] <= MASK
        place = np.minimum(np.arange(n) - units[unit], MASK).astype(np.uint64)
        return np.where(short, (mask[unit] >> place) & one == 1, border)

    def by_heap(self, text: str) -> list[bool]:
        """The borders of one long stretch: the best pair of neighbours is merged first, the left one among equals."""
        n, normal = len(text), self.normal
        end, back, border = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and end[b] - a <= self.longest and (hit := normal.get(text[a : end[b]])):
                heapq.heappush(heap, (-hit[0], a, end[b]))

        for a in range(n):
            offer(a)
        while heap:
            _, a, e = heapq.heappop(heap)
            if border[a] and (b := end[a]) < n and end[b] == e:
                border[b], end[a] = False, e
                if e < n:
                    back[e] = a
                offer(a)
                if back[a] >= 0:
                    offer(back[a])
        return border

    def clear(self) -> None:
        super().clear()
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet, in slices."""
        at = 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and (to == at or size + len(words[to]) <= SLICE):
                size += len(words[to])
                to += 1
            self._slice(words[at:to])
            at = to

    def _slice(self, words: list[str]) -> None:
        text = "".join(words)
        self.chars += len(text)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(lengths)
        first = np.zeros(len(chars), bool)
        first[stops - lengths] = True
        edges = self.edges(chars, np.repeat(stops, lengths))
        begin = np.flatnonzero(self.borders(text, chars, first, edges))
        size = np.diff(np.append(begin, len(chars)))
        keys = edges[0] * 64 + edges[1]
        order = np.argsort(keys)
        spot = np.minimum(np.searchsorted(keys[order], begin * 64 + size), max(len(keys) - 1, 0))
        ids = edges[3][order][spot] if len(keys) else np.zeros(len(begin), np.int64)
        missing = keys[order][spot] != begin * 64 + size if len(keys) else np.ones(len(begin), bool)
        ids[missing] = -1 - chars[begin[missing]].astype(np.int64)
        cuts = np.searchsorted(begin, stops).tolist()
        flat, odd, lo = ids.astype("<i4").tobytes(), set(np.searchsorted(stops, begin[missing], "right").tolist()), 0
        for i, (word, hi) in enumerate(zip(words, cuts, strict=True)):
            own = flat[4 * lo : 4 * hi]
            if i in odd:
                spelled = (((t,) if t >= 0 else (self.byte_ids[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass"))) for t in ids[lo:hi].tolist())
                own = np.array([x for s in spelled for x in s], "<i4").tobytes()
            self[word] = own
            lo = hi


def _worker_lattice(shared) -> Lattice:
    """This process's lattice for a broadcast vocabulary; Python workers serve many tasks."""
    held = sys.modules.setdefault("_motionframe_lattices", ModuleType("_motionframe_lattices")).__dict__
    normal, byte_ids, longest, name = shared.value
    if name not in held:
        held.update({name: Lattice(normal, byte_ids, longest)})
    return held[name]


def _slices(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in a row with at most ``CUT`` characters of text and 1,000 rows; a longer text stands alone."""
    size, lo = 0, 0
    for i, text in enumerate(f["text"]):
        n = len(text or "")
        if i > lo and (size + n > CUT or i - lo >= 1000):
            yield f.iloc[lo:i]
            size, lo = 0, i
        size += n
    if len(f) > lo:
        yield f.iloc[lo:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of ``docs``."""
    known = pieces(path)
    shared = docs.sparkSession.sparkContext.broadcast((known.normal, known.byte_ids, known.longest, path or default_path()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _worker_lattice(shared)
        for f in frames:
            for part in _slices(f):
                cut = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in part["text"]]
                if len(words) > CACHED or words.chars > HELD:
                    words.clear()
                words.learn([w for w in set().union(*cut) if w not in words])
                ids = [np.frombuffer(b"".join(map(words.__getitem__, row)), "<i4") for row in cut]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) for x in ids], "ids": ids})

    return long_id(docs.select(text_id("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids array<int>"), "doc_id")


def viterbi_segments(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(seg, n, ids) of the distinct segments of ``docs``: how often they stand, and the best path by the sum of piece scores."""
    known = pieces(path)
    words = docs.select(F.explode(segments(F.col("text"))).alias("seg")).groupBy("seg").agg(F.count("*").alias("n"))
    # The lattice keeps the partitioning by segment, so its edges are grouped without a further shuffle.
    paths = lattice(words.select("seg"), piece_table(docs.sparkSession, known), known.longest).select("seg", viterbi(F.col("seg"), F.col("edges")).alias("ids"))
    return words.join(paths, "seg").select("seg", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) again from ids: pieces and bytes in a row, escaped spaces turned back, the first one dropped."""
    known = pieces(path)
    shared = encoded.sparkSession.sparkContext.broadcast((known.by_id, known.byte_ids))

    @F.pandas_udf("string")
    def joined(rows: pd.Series) -> pd.Series:
        by_id, byte_ids = shared.value
        raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in by_id]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        return pd.Series([b"".join(raw[i] for i in ids).decode("utf-8", "replace").removeprefix(" ") if ids is not None else None for ids in rows])

    return encoded.select("doc_id", joined("ids").alias("text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every row of ``documents``."""
    return encode(table(spark, sf_dir, "documents"))


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` decoded from their ids: code points, and a hash of the text."""
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths, by the sum of piece scores, of all segments of ``benchmark``, folded by Spark."""
    return viterbi_segments(table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece, "piece_round_trip": piece_round_trip, "piece_viterbi": piece_viterbi}
ORACLE = {"piece_round_trip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents"}
