"""Online loss detection, overlap compaction and timeouts over streams of tracked cells.

The machine: a frame on the picture whose confidence is under ``LOW`` counts towards a dip; ``COUNT`` of them
in a row make the point lost, back to the dip's first frame; while lost, ``COUNT`` good frames in a row
recover it from the first of them. Frames off the picture neither count nor end a dip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, COUNT = 0.25, 16
RESULT = "camera string, name string, frame long, lost boolean, version long"


@dataclass
class LossMachine:
    lost: bool = False
    first: int = -1
    count: int = 0

    def step(self, frame: int, confidence: float, inside: bool) -> list[tuple[int, int, bool]]:
        """Spans (from, to, lost) that a frame settles or revises."""
        if not inside:
            return [(frame, frame, self.lost)]
        against = (confidence < LOW) != self.lost
        if not against:
            self.count = 0
            return [(frame, frame, self.lost)]
        if self.count == 0:
            self.first = frame
        self.count += 1
        if self.count < COUNT:
            return [(frame, frame, self.lost)]
        self.lost, self.count = not self.lost, 0
        return [(self.first, frame, self.lost)]


def _replayed(f: pd.DataFrame, machine: LossMachine, seen: list[list[int]]) -> tuple[list[tuple[int, bool, int]], list[list[int]]]:
    """(frame, lost, version) rows for frames in order; ``seen`` are runs (from, to) of earlier frames that may still be revised.

    Runs keep the state small: while a dip is open, frames off the picture only lengthen the last run.
    """
    out: list[tuple[int, bool, int]] = []
    for frame, confidence, inside in zip(f["frame"], f["confidence"], f["inside"], strict=True):
        frame = int(frame)
        if seen and seen[-1][1] + 1 >= frame:
            seen[-1][1] = max(seen[-1][1], frame)
        else:
            seen.append([frame, frame])
        for lo, hi, lost in machine.step(frame, float(confidence), bool(inside)):
            if lo == hi:
                out.append((frame, lost, frame))
            else:
                out += [(x, lost, frame) for a, b in seen for x in range(max(a, lo), min(b, hi) + 1)]
        if not machine.count:
            seen = []
        elif seen[0][0] < machine.first:
            seen = [[max(a, machine.first), b] for a, b in seen if b >= machine.first]
    return out, seen


def loss_batch(cells: DataFrame) -> DataFrame:
    """(camera, name, frame, lost): the machine over whole series (camera, name, frame, confidence, inside)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        rows, _ = _replayed(f, LossMachine(), [])
        got = pd.DataFrame(rows, columns=["frame", "lost", "version"]).drop_duplicates("frame", keep="last")
        return got.assign(camera=f["camera"].iloc[0], name=f["name"].iloc[0])[["camera", "name", "frame", "lost", "version"]]

    return cells.groupBy("camera", "name").applyInPandas(run, RESULT).drop("version")


def loss_stream(cells: DataFrame) -> DataFrame:
    """The same over a stream, in update mode: a revised frame comes again with a higher ``version``; the highest counts."""
    state = "lost boolean, first long, count int, seen array<array<long>>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.exists:
            lost, first, count, seen = held.get
            machine, seen = LossMachine(lost, first, count), [list(r) for r in seen]
        else:
            machine, seen = LossMachine(), []
        f = pd.concat(list(frames)).sort_values("frame")
        rows, seen = _replayed(f, machine, seen)
        held.update((machine.lost, machine.first, machine.count, seen))
        yield pd.DataFrame([(*key, *r) for r in rows], columns=["camera", "name", "frame", "lost", "version"])

    return cells.groupBy("camera", "name").applyInPandasWithState(run, RESULT, state, "update", "NoTimeout")


def compacted(versions: DataFrame) -> DataFrame:
    """The latest version of each frame."""
    return versions.groupBy("camera", "name", "frame").agg(F.max_by("lost", "version").alias("lost"))


def sessions(stream: DataFrame, gap: str = "1 day", late: str = "1 day", time: str = "ts", keys: tuple[str, ...] = ("camera",)) -> DataFrame:
    """Session windows per key over event time; rows later than the watermark are dropped by the engine."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def off_body_capped(cells: DataFrame, cap: float = 0.2) -> DataFrame:
    """Confidence of points off the silhouette capped; positions stay."""
    return cells.withColumn("confidence", F.when(F.col("off_body"), F.least("confidence", F.lit(cap))).otherwise(F.col("confidence")))
