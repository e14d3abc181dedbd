"""Series operators that built-in expressions can't state: filters, splines, spectra. One run or series is one group.

Groups are single runs of one landmark, so their size is bounded by a recording. The numeric parts are
plain functions of arrays and are tested without Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.operators.runs import SERIES, with_run

LEAST_FILTERED, LEAST_PICKED = 12, 36


def _second_order(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A second-order recursive filter that starts as if its first value had always been there."""
    y = np.empty_like(x)
    x1 = x2 = x[0]
    y1 = y2 = x[0] * b.sum() / a.sum()
    for i, v in enumerate(x):
        out = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x2, x1, y2, y1 = x1, v, y1, out
        y[i] = out
    return y


def butterworth(cutoff: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    k = math.tan(math.pi * cutoff / fps)
    q = 1 + math.sqrt(2) * k + k * k
    return np.array([k * k, 2 * k * k, k * k]) / q, np.array([1.0, 2 * (k * k - 1) / q, (1 - math.sqrt(2) * k + k * k) / q])


def _padded(x: np.ndarray, n_out: int, n_fit: int) -> np.ndarray:
    """The series with both ends continued along a parabola fitted to them."""

    def beyond(end: np.ndarray) -> np.ndarray:
        t = np.arange(len(end), dtype=float)
        fit = np.polynomial.polynomial.polyfit(t - t[-1], end, min(2, len(end) - 1))
        return np.polynomial.polynomial.polyval(np.arange(1, n_out + 1, dtype=float), fit)

    return np.concatenate([beyond(x[:n_fit][::-1])[::-1], x, beyond(x[-n_fit:])])


def lowpass(x: np.ndarray, fps: float, cutoff: float) -> np.ndarray:
    """Zero-phase low-pass of one run; short runs and cutoffs near the limit stay as they are."""
    if len(x) < LEAST_FILTERED or cutoff >= 0.98 * fps / 2:
        return x.copy()
    pad, fit = max(36, math.ceil(3 * fps / cutoff)), min(len(x), max(12, math.ceil(fps / cutoff)))
    b, a = butterworth(cutoff, fps)
    y = _second_order(_padded(x, pad, fit), b, a)
    return _second_order(y[::-1].copy(), b, a)[::-1][pad:-pad]


def residual_pick(x: np.ndarray, fps: float, n: int = 40) -> float | None:
    """Cutoff at which what a filter removes is what a noise line through the highest cutoffs predicts at 0."""
    if len(x) < LEAST_PICKED or np.ptp(x) == 0:
        return None
    half = fps / 2
    cuts = np.geomspace(max(0.5, 0.01 * half), 0.9 * half, n)
    left = np.array([math.sqrt(np.mean((x - lowpass(x, fps, c)) ** 2)) for c in cuts])
    tail = cuts >= 0.5 * half
    slope, level = np.polyfit(cuts[tail], left[tail], 1)
    under = np.flatnonzero(left <= max(level, 0))
    return float(cuts[under[0]]) if len(under) else float(cuts[-1])


def dominant_rhythm(x: np.ndarray, fps: float) -> float | None:
    """Frequency of a spectral peak at least 100 times the median power, else none."""
    n = len(x)
    if n < LEAST_PICKED:
        return None
    t = np.arange(n)
    power = np.abs(np.fft.rfft((x - np.polyval(np.polyfit(t, x, 1), t)) * np.hanning(n))) ** 2
    k = int(power[1:].argmax()) + 1
    middle = float(np.median(power[1:]))
    return float(k * fps / n) if power[k] > 0 and power[k] >= 100 * middle else None


def natural_spline(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with straight ends through (t, v); a line for two points, constant for one."""
    if len(t) < 3:
        return np.interp(at, t, v)
    h = np.diff(t).astype(float)
    n = len(t)
    slope = np.diff(v) / h
    # Second derivatives solve a tridiagonal system, swept once down and once up; both ends are 0.
    over, c = np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * over[i - 1]
        over[i] = h[i] / pivot
        c[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * c[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        c[i] -= over[i] * c[i + 1]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    return (c[k] * a**3 + c[k + 1] * b**3) / (6 * h[k]) + (v[k] / h[k] - c[k] * h[k] / 6) * a + (v[k + 1] / h[k] - c[k + 1] * h[k] / 6) * b


def gcc_phat(a: np.ndarray, b: np.ndarray, max_lag: int) -> tuple[int, float]:
    """Lag of ``b`` against ``a`` by the whitened correlation, and its peak over the next best one elsewhere."""
    n = 1 << (len(a) + len(b) - 1).bit_length()
    s = np.fft.rfft(b, n) * np.conj(np.fft.rfft(a, n))
    c = np.fft.irfft(s / np.maximum(np.abs(s), 1e-12), n)
    lags = np.arange(-max_lag, max_lag + 1)
    c = c[lags]
    k = int(c.argmax())
    rest = np.abs(lags - lags[k]) >= 3
    second = float(c[rest].max()) if rest.any() else 0.0
    return int(lags[k]), float(c[k] / second) if second > 0 else math.inf


def smoothed(cells: DataFrame, fps: float, cutoff: float | None = None, values: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds ``s_<value>``: every run filtered alone with one shared cutoff, the median of the runs' own picks if none is given."""
    d = with_run(cells, keys).select(*keys, "run", "frame", *values)
    if cutoff is None:
        picks = d.groupBy(*keys, "run").applyInPandas(lambda f: pd.DataFrame({"pick": [residual_pick(f.sort_values("frame")[values[0]].to_numpy(float), fps)]}, dtype="float64"), "pick double")
        cutoff = picks.agg(F.median("pick")).first()[0] or fps / 2

    def series(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        cuts = np.flatnonzero(np.diff(f["run"].to_numpy())) + 1
        return f.assign(**{f"s_{v}": np.concatenate([lowpass(x, fps, cutoff) for x in np.split(f[v].to_numpy(float), cuts)]) for v in values})

    kinds = ", ".join(f"`{k}` {t}" for k, t in d.dtypes)
    return d.groupBy(*keys).applyInPandas(series, kinds + "".join(f", s_{v} double" for v in values))


def rhythms(cells: DataFrame, fps: float, value: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """(keys, start, n, rhythm): the dominant frequency of every run, NULL where no peak stands out or the run is short."""
    d = with_run(cells, keys).select(*keys, "run", "frame", F.col(value).cast("double").alias("__v"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in d.select(*keys).dtypes)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        return pd.DataFrame([(*key[:-1], int(f["frame"].iloc[0]), len(f), dominant_rhythm(f["__v"].to_numpy(), fps))], columns=[*keys, "start", "n", "rhythm"]).astype({"rhythm": float})

    found = d.groupBy(*keys, "run").applyInPandas(run, f"{kinds}, start long, n long, rhythm double")
    return found.withColumn("rhythm", F.nullif(F.col("rhythm"), F.lit(float("nan"))))


def keyframes_interpolated(cells: DataFrame, width: int, height: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Cells made by splines through the hand-placed ones where a series has none, on the picture only, with confidence 0.6."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        hand = f[f["hand_placed"]]
        if len(hand) < 2:
            return f.iloc[:0][["camera", "name", "frame", "x", "y"]].assign(confidence=pd.Series(dtype=float))
        t = hand["frame"].to_numpy(float)
        at = np.setdiff1d(np.arange(int(t[0]), int(t[-1]) + 1), f["frame"].to_numpy())
        x, y = (natural_spline(t, hand[c].to_numpy(float), at.astype(float)) for c in ("x", "y"))
        ok = (x >= -0.5) & (x < width - 0.5) & (y >= -0.5) & (y < height - 0.5)
        return pd.DataFrame({"camera": f["camera"].iloc[0], "name": f["name"].iloc[0], "frame": at[ok], "x": x[ok], "y": y[ok], "confidence": 0.6})

    return cells.groupBy(*keys).applyInPandas(run, "camera string, name string, frame long, x double, y double, confidence double")
