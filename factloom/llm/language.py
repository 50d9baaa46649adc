"""Language of a text by its nearest centroid.

A text is a normalised TF-IDF vector of letter 1- to 3-grams, hashed to a fixed width. Each language has several centroids
from clustering a bounded sample of its texts; the most similar centroid by cosine names the language, and a text less
similar than any text of the sample was, by a margin, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.plans.session import materialize

WIDTH = 1 << 14  # hashed grams
CLUSTERS = 4  # centroids of a language
SAMPLE = 384  # texts of a language that are clustered; document frequencies cover all
ROUNDS = 8
MARGIN = 0.5  # rejected below this part of the least similarity seen in the sample
MOST_LANGUAGES = 1000  # the model has MOST_LANGUAGES * CLUSTERS * WIDTH numbers at most
SLICE = 1 << 20  # characters counted at once
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams of codes, of which 0 stands between words."""
    two = codes[:-1] * np.uint64(0x110000) + codes[1:]
    three = two[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams = np.concatenate([codes[codes != 0] + np.uint64(1 << 60), two, three])
    grams ^= grams >> np.uint64(29)
    return ((grams * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text; empty arrays without a letter. A slice begins with the last two codes of the one before,
    whose own grams are not counted again, so grams span slices."""
    total, letters, carried = np.zeros(WIDTH, np.int64), 0, np.zeros(1, np.uint64)
    lower = (text or "").lower()
    for start in range(0, len(lower), SLICE):
        codes = np.frombuffer(lower[start:start + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
        letters += int((codes != 0).sum())
        codes = np.concatenate([carried, codes, np.zeros(int(start + SLICE >= len(lower)), np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one mark between words
        total += np.bincount(_grams(codes), minlength=WIDTH)
        carried = codes[-2:]
        if start + SLICE < len(lower):  # what the carried codes alone make comes again with the next slice
            total -= np.bincount(_grams(carried), minlength=WIDTH)
    if not letters:
        return np.empty(0, np.int64), np.empty(0)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.float64)


def _has_letter(text: Column) -> Column:
    """Whether gram_counts finds anything; only texts without a letter known to Java are looked at in Python."""
    @F.pandas_udf("boolean")
    def rare(texts: pd.Series) -> pd.Series:
        return pd.Series([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)

    known = text.rlike(r"\p{L}")
    return known | rare(F.when(~known, text))


def _vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = gram_counts(text)
    weights = (1 + np.log(counts)) * idf[found]
    return found, weights / (np.sqrt((weights * weights).sum()) or 1.0)


@dataclass
class LanguageModel:
    """languages[i] names centroids[i], a unit vector; least[i] is the similarity below which its texts are rejected."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, similarity, rejected); UNKNOWN, 0 and rejected without a letter."""
        found, weights = _vector(text, self.idf)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0, True
        likeness = self.centroids[found].T @ weights
        best = int(np.argmax(likeness))
        score = float(min(max(likeness[best], 0.0), 1.0))
        return self.languages[best], score, score < self.least[best]


def _document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts per bucket, over all texts; the last place counts the texts. Each task sends one row per bucket it has seen."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found, _ = gram_counts(text.as_py())
                seen[found] += 1
                seen[WIDTH] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], names=["bucket", "n"])

    total = np.zeros(WIDTH + 1)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row.bucket] = row.n
    return total


def cluster(vectors: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: first the vector nearest the mean, then the one least like those chosen, then rounds of
    assignment and averaging. Fewer if there are fewer distinct vectors."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    likeness = vectors @ vectors[chosen[0]]
    while len(chosen) < min(clusters, len(vectors)) and likeness.min() < 1 - 1e-6:
        chosen.append(int(np.argmin(likeness)))
        likeness = np.maximum(likeness, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.stack([vectors[nearest == k].mean(axis=0) if (nearest == k).any() else centroids[k] for k in range(len(centroids))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def _samples(spelt: DataFrame, sample: int) -> DataFrame:
    """lang, hash, text: the `sample` distinct texts of each language that come first in the order of a hash, or all.

    Chosen by hashes alone: the number of distinct ones per language, at most a row per language, thins them where they are
    read; the few that are left are ranked. Their list, at most `sample` rows a language, then picks the texts, so
    no other text is ever shuffled, however often any is repeated."""
    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    hashes = materialize(spelt.select("lang", "hash").distinct().withColumn("place", place), "language-hashes")
    sizes = hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages, for which the model is made")
    thin = hashes.join(F.broadcast(sizes), "lang").filter(F.col("place") < 8.0 * sample / F.col("n"))
    first = Window.partitionBy("lang").orderBy("place", "hash")
    chosen = thin.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample).select("lang", "hash", "place")
    return spelt.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "place", "hash").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> LanguageModel:
    """Learn from rows with a language; rows with null language, null text or no letter teach nothing.

    Document frequencies come from all rows. Clustered are the `sample` distinct texts of each language that come first in
    the order of a hash of the text, or all if there are fewer; only their vectors reach the task that clusters them. More
    than MOST_LANGUAGES languages are an error."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    frequency = _document_frequencies(rows.select("text"))
    idf = np.log((1 + frequency[WIDTH]) / (1 + frequency[:WIDTH])) + 1
    spelt = rows.filter(_has_letter(F.col("text"))).withColumn("hash", F.xxhash64("text"))

    @F.pandas_udf("buckets array<int>, weights array<float>")
    def vector(texts: pd.Series) -> pd.DataFrame:
        made = [_vector(t, idf) for t in texts]
        return pd.DataFrame({"buckets": [b.astype(np.int32) for b, _ in made], "weights": [w.astype(np.float32) for _, w in made]})

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        vectors = []
        for found, weights in group.sort_values(["place", "hash"], kind="stable")[["buckets", "weights"]].itertuples(index=False):
            if len(found):
                vectors.append(np.zeros(WIDTH, np.float32))
                vectors[-1][found] = weights
        if not vectors:
            return pd.DataFrame({"lang": [], "centroid": [], "least": []}, dtype=object)
        matrix = np.stack(vectors)
        made = cluster(matrix, clusters)
        least = MARGIN * float((matrix @ made.T).max(axis=1).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [c.astype(np.float32) for c in made], "least": least})

    few = _samples(spelt, sample).withColumn("vector", vector("text")).select("lang", "place", "hash", "vector.*")
    found = few.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, least double").collect()
    found.sort(key=lambda r: (r.lang, r.centroid))
    matrix = np.array([r.centroid for r in found], np.float32).reshape(len(found), WIDTH).T
    return LanguageModel(idf, [r.lang for r in found], np.ascontiguousarray(matrix), np.array([r.least for r in found]))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with __lang, __score (cosine, 0 to 1) and __rejected.

    Null texts and texts without a letter are UNKNOWN, 0.0 and rejected. Equal texts get equal answers; other columns are
    kept as they are; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    # one name is free for sure: it is longer than all others
    inner = "__p" + "_" * max(map(len, docs.columns))
    return docs.withColumn(inner, predict(F.col(text))).withColumns(
        {"__lang": F.col(f"{inner}.lang"), "__score": F.col(f"{inner}.score"), "__rejected": F.col(f"{inner}.rejected")}).drop(inner)
