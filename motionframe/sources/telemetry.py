"""Camera telemetry: nested key-length-value recordings, as action cameras write them, read from any store Spark knows.

An item is a four-letter key, a type, the bytes of a sample, a big-endian number of samples, and a payload padded
to four bytes; type 0 nests. A device (``DEVC``) holds streams (``STRM``); a stream's last item is its data, named by
its key, and the items before it describe it: its name (``STNM``), the number or numbers its values are divided by
(``SCAL``), its clock (``STMP``). Recordings are rows (path, content), as Spark's binary files are, so each file is
read by one task and a damaged one spoils nothing else.

Defined cases: where a recording is cut off, all samples of complete items count, and the item that is cut off has none;
unknown keys are data like others; unknown types have no samples; a divisor of zero gives no values; null content
gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Numbers by type letter, in numpy's terms; fixed-point types have a divisor.
NUMBERS = {"b": ">i1", "B": ">u1", "s": ">i2", "S": ">u2", "l": ">i4", "L": ">u4", "f": ">f4", "d": ">f8", "j": ">i8", "J": ">u8", "q": ">i4", "Q": ">i8"}
FIXED_POINT = {"q": 2.0**16, "Q": 2.0**32}
HEADER = 8
DESCRIBING = frozenset(("STNM", "SCAL", "STMP", "SIUN", "UNIT", "TSMP", "TYPE", "TICK", "TOCK", "EMPT", "DVID", "DVNM", "TIMO", "ORIN", "ORIO", "MTRX"))
ROWS = "path string, device int, stream int, key string, name string, block_time double, sample long, values array<double>"


def items(data: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """(key, type, bytes of a sample, payload) one after the other, up to the first that is cut off; of one that nests, what is there still counts."""
    at = 0
    while at + HEADER <= len(data):
        key, kind, size, repeat = data[at : at + 4], data[at + 4], data[at + 5], int.from_bytes(data[at + 6 : at + 8], "big")
        end = at + HEADER + size * repeat
        if key == bytes(4):
            return
        if end > len(data):
            if not kind:
                yield key.decode("latin-1"), "", size, data[at + HEADER :]
            return
        yield key.decode("latin-1"), chr(kind) if kind else "", size, data[at + HEADER : end]
        at = end + -(size * repeat) % 4


def numbers(kind: str, size: int, payload: bytes) -> np.ndarray | None:
    """(samples, values of a sample); None for types without numbers."""
    if kind not in NUMBERS or not size:
        return None
    width = np.dtype(NUMBERS[kind]).itemsize
    if size % width:
        return None
    return np.frombuffer(payload, NUMBERS[kind]).reshape(-1, size // width).astype(float) / FIXED_POINT.get(kind, 1.0)


def samples(data: bytes) -> Iterator[tuple[int, int, str, str | None, float | None, int, list[float]]]:
    """(device, stream, key, name, block time in seconds, sample, values) of a recording; devices and streams are counted over the whole of it."""
    device = stream = -1
    for outer, kind, _, payload in items(data):
        if kind or outer != "DEVC":
            continue
        device += 1
        for key, kind, _, inner in items(payload):
            if kind or key != "STRM":
                continue
            stream += 1
            name, scale, time = None, np.ones(1), None
            for key, kind, size, own in items(inner):
                values = numbers(kind, size, own)
                if key == "STNM":
                    name = own.split(b"\x00")[0].decode("latin-1")
                elif key == "SCAL" and values is not None:
                    scale = values.ravel()
                elif key == "STMP" and values is not None and values.size:
                    time = values[0, 0] / 1e6
                elif key not in DESCRIBING and values is not None and (scale != 0).all() and len(scale) in (1, values.shape[1]):
                    for i, row in enumerate(values / scale):
                        yield device, stream, key, name, time, i, row.tolist()


def item(key: str, kind: str, values: Sequence[Sequence[float]] | bytes) -> bytes:
    """An item of rows of numbers, of text (type c), or of items (type empty), padded."""
    if isinstance(values, bytes):
        size, repeat, payload = 1, len(values), values
        if not kind and repeat > 0xFFFF:
            size, payload = 4, values + bytes(-repeat % 4)
            repeat = len(payload) // 4
    else:
        rows = np.asarray(values, float)
        rows = rows.reshape(len(rows), -1)
        payload = (rows * FIXED_POINT.get(kind, 1.0)).round(0 if NUMBERS[kind][1] in "iu" else 12).astype(NUMBERS[kind]).tobytes()
        repeat, size = len(rows), len(payload) // max(len(rows), 1)
    return key.encode("latin-1") + struct.pack(">BBH", ord(kind) if kind else 0, size, repeat) + payload + bytes(-len(payload) % 4)


def device(streams: Sequence[tuple[str, str, str, Sequence[float], Sequence[Sequence[float]], float]]) -> bytes:
    """A device of streams (key, name, type, divisors, rows, time); rows are multiplied by the divisors."""
    made = b""
    for key, name, kind, scale, rows, time in streams:
        inner = item("STMP", "J", [[time * 1e6]]) + item("STNM", "c", name.encode("latin-1")) + item("SCAL", "l", [[s] for s in scale]) + item(key, kind, np.asarray(rows, float).reshape(len(rows), -1) * np.asarray(scale, float))
        made += item("STRM", "", inner)
    return item("DEVC", "", made)


def telemetry(recordings: DataFrame) -> DataFrame:
    """(path, device, stream, key, name, block_time, sample, values) of recordings (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, *row) for path, content in zip(f["path"], f["content"], strict=True) if content is not None for row in samples(bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    return recordings.select("path", "content").mapInPandas(run, ROWS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry of all files below ``path``."""
    return telemetry(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
