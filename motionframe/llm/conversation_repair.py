"""Repair of conversation structure by cheapest edits, with dynamic programming shared over a prefix trie.

1. Rows get a mark: the class of their role and their first fault. A conversation's marks in order are its
   signature. Only marks and digests are shuffled here, no texts.
2. Distinct signatures are sorted; in sorted order a signature shares its longest common prefix with the one
   before it, so walking them visits a prefix trie depth first. A stack holds the layers of the current path:
   each layer is computed once for a shared prefix, and the terminal nodes give the answers.
3. Answers join their conversations, and a second pass over the texts, shuffled once, follows the audit and
   hashes the repaired conversation row by row.

A layer has the best edits for each state of ``(s?(ua)+)?``: cost, back pointer, last letters, and the rank of
their audit among those of the layer. All audits of a layer have as many row letters and end in one, so none
is another's prefix, and ranks settle ties without the strings. Memory grows with one conversation's number
of rows (some numbers each), never with its texts.

Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows),
Insert an empty user or assistant row 5; truncated rows that stay add 5. Of equal costs the audit that is
least in ASCII wins.

Defined cases: a null role or text is one space (so the row is blank); rows with a null turn come first and
don't count in gaps; rows without a conversation id form one conversation whose id is null; repeated rows are
duplicates of each other; ties of turn go by the digest of role and text; empty and very long texts are rows
like others; an empty table gives an empty result; only the four columns are read, so further columns can
have any names. One conversation is hashed by one task, as a SHA-256 asks for, row by row in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from sys import intern

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionframe.llm._common import SPACES, long_id, table, text_id, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ENDS = ".!?"
LEGAL_PAIRS = ("su", "ua", "au")

# States: nothing yet, after system, after user, after assistant. What an inserted or reroled row leads to, and where a conversation may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (NONE, ASSISTANT)
#: More inserts in a row would come back to a state at a higher cost.
MOST_INSERTS = 2


def _kept(state: int, role: str) -> int | None:
    """The state after a row whose role has that initial; None where it can't follow."""
    if role == "s":
        return SYSTEM if state == NONE else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def _moves(mark: str) -> list[tuple[int, str, int, int]]:
    """(from, letters, to, cost) of one row: up to two inserts before it, then its own letter."""
    role, extra, moves = mark.lower(), TRUNCATED * mark.isupper(), []
    for start in NEXT:
        state, letters, cost = start, "", 0
        for _ in range(MOST_INSERTS + 1):
            moves.append((start, letters + "D", state, cost + DELETE))
            if mark != "x":
                moves.append((start, letters + "R", NEXT[state], cost + REROLE + extra))
                if (to := _kept(state, role)) is not None:
                    moves.append((start, letters + "K", to, cost + KEEP + extra))
            state, letters, cost = NEXT[state], letters + "I", cost + INSERT
    return moves


#: Marks of a signature: role class s, u, a or o (other), a capital where truncated; x must be deleted.
MOVES = {mark: _moves(mark) for mark in "suaoSUAOx"}

#: For each state that can be reached: (cost, rank, state before, letters).
Layer = dict[int, tuple[int, int, int, str]]
FIRST: Layer = {NONE: (0, 0, NONE, "")}


def next_layer(layer: Layer, mark: str) -> Layer:
    best: dict[int, tuple[int, int, str, int]] = {}
    for start, letters, to, cost in MOVES[mark]:
        if start in layer:
            found = (layer[start][0] + cost, layer[start][1], letters, start)
            if to not in best or found < best[to]:
                best[to] = found
    order = {to: rank for rank, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return {to: (cost, order[to], start, letters) for to, (cost, _, letters, start) in best.items()}


def answer(layers: list[Layer]) -> tuple[int, str]:
    """(cost, audit) of the path that ends in an accepted state."""
    ends = []
    for state, (cost, rank, _, _) in layers[-1].items():
        at, inserts = state, 0
        while at not in ACCEPTED:
            at, inserts = NEXT[at], inserts + 1
        ends.append((cost + INSERT * inserts, rank, inserts, state))
    cost, _, inserts, state = min(ends)
    letters = ["I" * inserts]
    for layer in reversed(layers[1:]):
        _, _, before, own = layer[state]
        letters.append(own)
        state = before
    return cost, "".join(reversed(letters))


def walked(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures in sorted order; layers of the prefix shared with the one before are kept."""
    layers, last = [FIRST], ""
    for s in signatures:
        shared = 0
        for x, y in zip(s, last, strict=False):
            if x != y:
                break
            shared += 1
        del layers[shared + 1 :]
        for mark in s[shared:]:
            layers.append(next_layer(layers[-1], mark))
        last = s
        yield (s, *answer(layers))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage; a dropped row stays with ``gone``, so that its conversation isn't lost."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    own = own.withColumn("code", code)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _digest() -> Column:
    """Of role and text; the length keeps them apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))


def _summaries(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation in ``rows``."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    role = F.substring("role", 1, 1)
    role = F.when(role.isin("s", "u", "a"), role).otherwise("o")
    slim = rows.select("conv_id", "turn", "gone", _digest().alias("digest"), role.alias("role"), (last == "").alias("blank"), F.when(last.isin(*ENDS), "k").otherwise("t").alias("end"))
    slim = slim.repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "digest", "gone").orderBy("turn"))
    fault = F.when(F.col("blank"), "b").when(F.col("nth") > 1, "d").otherwise(F.col("end"))
    marked = slim.withColumn("nth", nth).select("conv_id", "turn", "digest", "nth", F.when(F.col("gone"), "").otherwise(F.concat("role", fault)).alias("mark"))
    order = marked.sortWithinPartitions("conv_id", "turn", "digest", "nth").select(text_id("conv_id"), text_id("turn"), "mark")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, marks, turns, began = None, [], None, False

        def summary() -> tuple:
            roles, faults = "".join(m[0] for m in marks), "".join(m[1] for m in marks)
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            signature = "".join("x" if f in "bd" else r.upper() if f == "t" else r for r, f in zip(roles, faults, strict=True))
            return conv, gaps, *(faults.count(f) for f in "bdt"), sum(x + y not in LEGAL_PAIRS for x, y in pairwise(roles)), signature

        for f in frames:
            out = []
            for c, turn, mark in zip(f["conv_id"], f["turn"], f["mark"], strict=True):
                c = None if pd.isna(c) else c
                if not began or c != conv:
                    if began:
                        out.append(summary())
                    conv, marks, turns, began = c, [], None, True
                if mark:
                    marks.append(intern(mark))
                    if not pd.isna(turn):
                        t = int(turn)  # in order: first, last and number of distinct turns so far
                        turns = (t, t, 1) if turns is None else (turns[0], t, turns[2] + (t != turns[1]))
            yield pd.DataFrame(out, columns=columns)
        if began:
            yield pd.DataFrame([summary()], columns=columns)

    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    return long_id(order.mapInPandas(run, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"), "conv_id")


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct ``signature``s: ranges of the sorted signatures are walked as tries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = walked(s for f in frames for s in f["signature"])
        while rows := [row for _, row in zip(range(1000), found)]:  # noqa: B905
            yield pd.DataFrame(rows, columns=["signature", "cost", "audit"])

    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = signatures.repartitionByRange(parts, "signature").sortWithinPartitions("signature")
    return ranges.mapInPandas(run, "signature string, cost long, audit string")


class _Repair:
    """Hash of a repaired conversation, fed with its rows in order."""

    def __init__(self, summary: dict) -> None:
        self.summary, self.audit, self.at, self.state, self.hash, self.began = summary, summary["audit"], 0, NONE, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.hash.update(("\n" * self.began + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.began = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEXT[self.state]
            self._add(ROLES[self.state], "")
            self.at += 1

    def feed(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            self._add(ROLES[self.state], text)
        elif edit == "K":
            self.state = _kept(self.state, role[:1])
            self._add(role, text)

    def row(self) -> dict:
        self._inserts()
        return self.summary | {"repaired_sha256": self.hash.hexdigest()}


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation after the damage."""
    rows = damaged(conversations)
    found = written(_summaries(rows), "signatures")
    answers = cheapest_edits(found.select("signature").distinct())
    solved = found.join(answers, "signature").drop("signature")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = solved.select(*columns, F.lit(0).alias("kind"))
    texts = rows.where("not gone").select("conv_id", "turn", _digest().alias("digest"), "role", "text", F.lit(1).alias("kind"))
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    numbers = [c for c in columns if c not in ("conv_id", "audit")]
    stream = stream.select(text_id("conv_id"), "kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "audit", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: _Repair | None = None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.kind == 0:
                    if current is not None:
                        out.append(current.row())
                    current = _Repair({c: getattr(r, c) for c in columns})
                else:
                    current.feed(r.role, r.text)
            yield pd.DataFrame(out, columns=[*columns, "repaired_sha256"])
        if current is not None:
            yield pd.DataFrame([current.row()])

    return long_id(stream.mapInPandas(run, "conv_id string, " + ", ".join(f"{c} long" for c in numbers) + ", audit string, repaired_sha256 string"), "conv_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all damaged ``conversations``."""
    return repaired(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
#: The same program row by row, without signatures or a trie; CRC-32 bit by bit.
ORACLE = {
    "op11_conversation_repair": r"""
        WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
        c AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(k, lambda x: CAST(ascii(x) AS BIGINT)), lambda h, b: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)), xor(h, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS code FROM s),
        r AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE code <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, sha256(octet_length(encode(role)) || ':' || role || text) AS digest FROM r),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, nth) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM n),
        m AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS initial FROM o),
        p AS (SELECT *, i > 1 AND lag(initial) OVER w || initial NOT IN ('su', 'ua', 'au') AS broken FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        f AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (broken) AS illegal FROM p GROUP BY conv_id),
        g(p, letters, q, cost, rows) AS (VALUES ('', '', '', 0, CAST([] AS VARCHAR[])), ('', 'I', 'u', 5, ['user:']), ('', 'II', 'a', 10, ['user:', 'assistant:']), ('s', '', 's', 0, []), ('s', 'I', 'u', 5, ['user:']), ('s', 'II', 'a', 10, ['user:', 'assistant:']),
            ('u', '', 'u', 0, []), ('u', 'I', 'a', 5, ['assistant:']), ('u', 'II', 'u', 10, ['assistant:', 'user:']), ('a', '', 'a', 0, []), ('a', 'I', 'u', 5, ['user:']), ('a', 'II', 'a', 10, ['user:', 'assistant:'])),
        e(p, letter, initial, q) AS (VALUES ('', 'D', NULL, ''), ('s', 'D', NULL, 's'), ('u', 'D', NULL, 'u'), ('a', 'D', NULL, 'a'), ('', 'R', NULL, 'u'), ('s', 'R', NULL, 'u'), ('u', 'R', NULL, 'a'), ('a', 'R', NULL, 'u'),
            ('', 'K', 's', 's'), ('', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a')),
        all_convs AS (SELECT DISTINCT conv_id FROM conversations),
        dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS best FROM all_convs
            UNION ALL
            SELECT dp.conv_id, dp.i + 1, e.q, min({'c': best.c + g.cost + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END, 'a': best.a || letters || letter,
                'r': best.r || g.rows || CASE letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [role || ':' || text] ELSE [CASE e.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END})
            FROM dp JOIN p ON p.conv_id IS NOT DISTINCT FROM dp.conv_id AND p.i = dp.i + 1 JOIN g ON g.p = dp.state JOIN e ON e.p = g.q AND (letter = 'D' OR fault NOT IN ('b', 'd')) AND (letter <> 'K' OR e.initial = p.initial)
            GROUP BY dp.conv_id, dp.i, e.q),
        z AS (SELECT dp.conv_id, min({'c': best.c + cost, 'a': best.a || letters, 'r': best.r || rows}) AS best FROM dp LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN g ON g.p = state AND g.q IN ('', 'a') WHERE i = coalesce(n, 0) GROUP BY dp.conv_id)
        SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
        FROM z LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
