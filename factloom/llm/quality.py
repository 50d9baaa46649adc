"""Quality of a text by Bradley-Terry pairwise ranking.

A document's worth is a weighted sum of features of its whole text. Weights are learned from preference pairs, a document
labelled 1 over one labelled 0, by logistic loss on the difference of their features. The share of 0 among the labels gives
the quantile of the worths at which the decision falls.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import materialize

SAMPLE = 20_000  # labelled rows that are learned from, at most
PAIRS = 300_000  # preference pairs, at most
RIDGE = 1e-3
CUT = 0.3  # the score at the quantile of the decision
WIDTH = 29  # features of a text

_PLAIN = np.zeros(256, bool)
_PLAIN[list(b" \t\r\n.,;:'\"-?()")] = True
_PLAIN[128:] = True  # parts of letters, mostly
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
for _kind in (_UPPER, _LOWER, _DIGIT):
    _PLAIN[_kind] = True


def features(text: str | None) -> list[float]:
    """Shares and lengths that describe the whole text; zeros for null, empty and blank texts."""
    words = (text or "").split()
    if not words:
        return [0.0] * WIDTH
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, n = int(raw.sum()), len(words)
    lines = [x for x in text.split("\n") if x]
    letters = max(1, int(raw[_UPPER].sum() + raw[_LOWER].sum()))
    pairs = max(1, n - 1)
    shares = [
        raw[_UPPER].sum() / letters, raw[_DIGIT].sum() / size, raw[~_PLAIN].sum() / size,
        raw[ord("!")] / n, raw[ord("|")] / n, raw[list(b".?")].sum() / n, raw[ord(",")] / n,
        1 - len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / pairs,
        1 - len(set(zip(words, words[1:]))) / pairs, 1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, max(map(len, words)) / size,
    ]
    shares = [float(s) for s in shares]
    return [1.0, *shares, *(s ** 0.5 for s in shares)]


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the features of each row's text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, features array<double>")


@dataclass
class Ranking:
    """score(x) = logistic(x . weights + offset)."""

    weights: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -500, 500)))


def preference_pairs(good: int, bad: int, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of better and worse documents: every document of the rarer label meets equally many of the other, spread evenly."""
    if not good or not bad:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    each = max(1, min(max(good, bad), most // min(good, bad)))
    rare = np.repeat(np.arange(min(good, bad)), each)
    step = max(good, bad) / each
    other = ((np.tile(np.arange(each), min(good, bad)) * step).astype(np.int64) + rare * 7919) % max(good, bad)
    return (rare, other) if good <= bad else (other, rare)


def learn(x: np.ndarray, label: np.ndarray, rounds: int = 25) -> Ranking:
    """Newton steps on the logistic loss of feature differences. With labels of one kind only, all worths are equal."""
    width = x.shape[1]
    better, worse = preference_pairs(int((label == 1).sum()), int((label == 0).sum()))
    if not len(better):
        return Ranking(np.zeros(width), 20.0 if (label == 1).any() else float(np.log(CUT / (1 - CUT))))
    spread = x.std(axis=0)
    scale = np.where(spread > 1e-12, spread, 1.0)
    difference = (x[label == 1][better] - x[label == 0][worse]) / scale
    weights = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -500, 500)))  # chance that the worse one wins
        slope = difference.T @ p / len(p) - RIDGE * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    weights /= scale
    worth = x @ weights
    border = float(np.quantile(worth, (label == 0).mean()))
    return Ranking(weights, float(np.log(CUT / (1 - CUT))) - border)


def train(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Ranking:
    """Learn from the labelled documents (label 0 or 1; others and nulls teach nothing) that come first in the order of a hash
    of doc_id, `sample` at most. Repeated labels and documents count once, labels of other documents not at all; a document may
    have both labels."""
    marked = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    known = marked.distinct().join(measured.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = measured.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "features").dropDuplicates(["doc_id", "label"])
    rows = rows.collect()  # `sample` rows at most
    rows.sort(key=lambda r: (r.doc_id, r.label))
    x = np.array([r.features for r in rows]) if rows else np.empty((0, WIDTH))
    return learn(x, np.array([r.label for r in rows]))


def rate(measured: DataFrame, ranking: Ranking) -> DataFrame:
    """Add score to measured rows. Null and empty texts have the features 0, like any other text without words."""
    weights, offset = ranking.weights.tolist(), ranking.offset

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(Ranking(np.array(weights), offset).scores(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    return measured.withColumn("score", score("features"))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, at least CUT above the quantile). Learns from all given labels.

    Features are computed once and stored. Repeated rows get one score each; other columns take no part; null ids are scored
    but never learned from; an empty table gives an empty result."""
    measured = materialize(measure(docs, doc_id, text), "quality-features")
    return rate(measured, train(measured, labels, doc_id)).select("doc_id", "score")
