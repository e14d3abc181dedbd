"""Quality scores learned from preference pairs (Bradley-Terry), thresholded by a score quantile.

A document's strength is a linear function of text features. For a preferred and a rejected document the
chance that the first wins is the logistic function of the difference of their strengths, so the weights
are fitted by logistic loss on feature differences. The cut is a quantile of the strengths of the labelled
sample (the share of rejected rows in it), and scores are shifted so that the cut has the score ``at``.

Only the model is fitted on a bounded sample: ``sample_rows`` labelled rows in the order of a hash of their
ids, ``pairs`` pairs drawn from them with a fixed seed. Every text is scored whole.

Defined cases: a null text counts as empty and gets a score like any other; rows without an id are scored
and never used for fitting; repeated rows get equal scores; a document labelled more than once counts as
preferred if at least half its labels do; null labels are left out; without labels of both kinds there are
no pairs and every score is 0.5; scores equal to the cut pass it (ties); texts of any length are scored
whole, in time linear in their length; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionframe.llm._common import table

SAMPLE_ROWS = 20_000
PAIRS = 100_000
CUT = 0.3

FEATURES = ("log_words", "word_length", "symbols", "bars", "exclamations", "capitals", "digits", "marks", "stutter", "distinct_words", "distinct_fours", "distinct_lines", "squeezed", "short")

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = b".,;:?'\"()-"
_SYMBOL = b"#*$%&<>@^~=+_{}[]\\"


def features(text: str | None) -> list[float]:
    """Shares and counts of the whole text, each in a range near 0 to 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    share = lambda chars: size and (len(raw) - len(raw.translate(None, chars))) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    fours = zip(words, words[1:], words[2:], words[3:], strict=False)
    return [
        math.log1p(len(words)) / 8,
        min(size / n / 10, 3.0),
        min(share(_SYMBOL), 3.0),
        min(share(b"|"), 1.0),
        min(share(b"!"), 2.0),
        min(share(_UPPER) / 2, 3.0),
        min(share(_DIGIT), 2.0),
        min(share(_MARK), 2.0),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        (len(set(fours)) + 1) / max(len(words) - 2, 1),
        len(set(lines)) / max(len(lines), 1),
        min(len(zlib.compress(raw, 1)) / size, 1.5),
        float(len(words) < 20),
    ]


@dataclass(frozen=True)
class BradleyTerry:
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    cut: float
    at: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.centre)) / np.array(self.spread), -8, 8) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z - self.cut + math.log(self.at / (1 - self.at)), -500, 500)))


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, at: float = CUT, decay: float = 1e-3, seed: int = 5) -> BradleyTerry:
    """Newton's method on the mean logistic loss over differences (preferred minus rejected)."""
    k = x.shape[1]
    first, second = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(first) or not len(second):
        return BradleyTerry((0.0,) * k, (0.0,) * k, (1.0,) * k, math.log(at / (1 - at)), at)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    m = min(pairs, len(first) * len(second))
    d = z[rng.choice(first, m)] - z[rng.choice(second, m)]
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + decay * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + decay * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strengths = np.sort(z @ w)
    return BradleyTerry(tuple(w), tuple(centre), tuple(spread), float(np.quantile(strengths, len(second) / len(strengths), method="midpoint")), at)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS, at: float = CUT) -> BradleyTerry:
    """A model from labelled rows that aren't held out; at most ``sample_rows`` of them reach the driver, as features."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").alias("__label")).where("__id is not null and __label is not null")
    voted = own.where(~_held_out(F.col("__id"))).groupBy("__id").agg((F.avg("__label") >= 0.5).alias("__good"))
    some = voted.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["__id"], "good": f["__good"], "x": [features(t) for t in f["__text"]]})

    measured = texts.join(F.broadcast(some), "__id").mapInPandas(run, "id long, good boolean, x array<double>")
    # One row for each id of the sample, so that repeated rows stay in Spark; a hot id is combined before the shuffle.
    rows = measured.groupBy("id").agg(F.min(F.struct("x", "good")).alias("r")).select("id", "r.x", "r.good").toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_pairs(x, rows["good"].to_numpy(bool), pairs, at)


def score(text: Column, model: BradleyTerry) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))))

    return scored(text)


def filter_documents(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score at least the cut.

    ``labelled`` holds the texts that labels refer to; ``docs`` itself by default. Where earlier filters have
    already taken most rejected documents away, give the unfiltered table, or the model sees one kind only.
    """
    model = fit(docs if labelled is None else labelled, labels)
    return docs.where(score(F.col("text"), model) >= model.at)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
