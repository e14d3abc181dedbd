"""Telemetry recordings: round trips of every type, nesting, padding, cuts and damage."""

import struct

import numpy as np
import pytest

from motionframe.sources import telemetry


def test_items_of_every_type():
    for kind, values in (("b", [[-3]]), ("B", [[200]]), ("s", [[-300, 5]]), ("S", [[60000]]), ("l", [[-70000, 1, 2]]), ("L", [[4_000_000_000]]), ("f", [[0.5]]), ("d", [[0.1, 0.2]]), ("j", [[-(2**40)]]), ("J", [[2**50]]), ("q", [[1.5]]), ("Q", [[-2.25]])):
        data = telemetry.item("ABCD", kind, values)
        assert len(data) % 4 == 0
        ((key, k, size, payload),) = telemetry.items(data)
        assert key == "ABCD" and k == kind and telemetry.numbers(k, size, payload).tolist() == pytest.approx(np.array(values, float))
    # By hand, as the format is published: key, type, bytes of a sample, samples, payload, padding.
    assert telemetry.item("TEST", "s", [[1], [2], [3]]) == b"TEST" + b"s" + struct.pack(">BH", 2, 3) + struct.pack(">hhh", 1, 2, 3) + b"\0\0"
    assert telemetry.numbers("c", 1, b"ab") is None and telemetry.numbers("l", 3, b"abc") is None


def test_recordings(spark, tmp_path):
    one = telemetry.device([("ACCL", "Accelerometer", "s", (418,), [[0.5, -1.25, 9.81], [1.0, 2.0, 3.0]], 1.5), ("SHUT", "Exposure", "f", (1,), [[0.01]], 1.5)])
    two = telemetry.device([("ACCL", "Accelerometer", "s", (418,), [[4.0, 5.0, 6.0]], 2.5)])
    odd = telemetry.item("DEVC", "", telemetry.item("DVNM", "c", b"Camera!") + telemetry.item("STRM", "", telemetry.item("SCAL", "l", [[0]]) + telemetry.item("GYRO", "s", [[1, 2, 3]])))
    files = {"a": one + two, "b": one[:-3], "c": b"", "d": odd + one, "e": b"\0" * 40, "f": one[:30], "g": b"not telemetry at all, whatever it is"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got: dict = {}
    for r in telemetry.read(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-1], []).append((r.device, r.stream, r.key, r.name, r.block_time, r.sample, [round(v, 2) for v in r["values"]]))
    first = [(0, 0, "ACCL", "Accelerometer", 1.5, 0, [0.5, -1.25, 9.81]), (0, 0, "ACCL", "Accelerometer", 1.5, 1, [1.0, 2.0, 3.0])]
    assert got["a"] == [*first, (0, 1, "SHUT", "Exposure", 1.5, 0, [0.01]), (1, 2, "ACCL", "Accelerometer", 2.5, 0, [4.0, 5.0, 6.0])]
    assert got["b"] == first and set(got) == {"a", "b", "d"}
    assert [(d, s + 1, *rest) for d, s, *rest in got["d"]] == [(d + 1, s + 2, *rest) for d, s, *rest in [*first, got["a"][2]]]
    df = spark.createDataFrame([("x", None), ("y", bytearray(two))], "path string, content binary")
    assert [r.path for r in telemetry.telemetry(df).collect()] == ["y"] and telemetry.telemetry(df.where("false")).count() == 0
    # A nested item of more than 65,535 bytes counts its payload in words.
    long = telemetry.device([("CORI", "Orientation", "l", (1000,), np.arange(60_000).reshape(-1, 4) / 1000, 0.0)])
    rows = list(telemetry.samples(long))
    assert len(rows) == 15_000 and rows[-1][-1] == pytest.approx([59.996, 59.997, 59.998, 59.999])
