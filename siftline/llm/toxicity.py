"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

The model gives each text one score, the sum of the weights of its features, and ordered
thresholds that all grades share it with: P(grade <= j) = logistic(threshold_j - score). It is
fitted on a bounded sample of labelled documents. Labels say toxic or not; a toxic document's
grade, from 1 to ``GRADES``, is its place among the sample's toxic documents by the number of its
words that have features. Features are whole words and beginnings of words, chosen by how much
more often toxic documents hold them than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, cut, table

#: Grades above 0.
GRADES = 3
#: At most so many labelled documents are fitted on, those whose ids' hashes are least.
LABELLED = 12_000
#: At most so many features are weighed, and each must be so much commoner in toxic documents.
FEATURES, LEAST_DEVIATIONS, LEAST_LOG_ODDS = 1024, 5.0, 1.5
BEGINNINGS = (4, 5, 6)
#: A document is rejected from this probability of any grade above 0.
REJECTED = 0.5
REMEMBERED = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word itself, and its beginnings, marked with a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


class Known(dict):
    """For a word, which of the chosen features it has; fills itself on demand."""

    def __init__(self, chosen: dict[str, int]) -> None:
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = tuple(self.chosen[f] for f in features(word) if f in self.chosen)
        self[word] = found
        return found

    def counts(self, text: str | None) -> Counter:
        """How often a text has each feature."""
        return Counter(chain.from_iterable(map(self.__getitem__, words(text))))


@dataclass
class OrdinalModel:
    """``names`` and ``weights`` of the features; ``thresholds`` between the grades, ascending."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= j) for j from 0 to one below the highest grade, a row for each score."""
        return logistic(self.thresholds[None, :] - scores[:, None])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, rounds: int = 600, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds with the least mean log loss plus ``ridge`` times the squared weights, by Adam steps.

    Entry i of the sparse matrix is ``values[i]`` at ``rows[i]``, ``columns[i]``. Thresholds are the first one
    and the logarithms of the steps up from it, so they stay ordered.
    """
    n, top = len(grades), GRADES
    shares = np.clip(np.cumsum(np.bincount(grades, minlength=top + 1))[:top] / n, 1e-4, 1 - 1e-4)
    begin = np.maximum.accumulate(np.log(shares / (1 - shares)) + np.arange(top) * 1e-3)
    p = np.concatenate([np.zeros(width), begin[:1], np.log(np.diff(begin))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        weights, steps = p[:width], np.exp(p[width + 1 :])
        thresholds = p[width] + np.concatenate([[0], np.cumsum(steps)])
        scores = np.bincount(rows, values * weights[columns], minlength=n)
        below = logistic(thresholds[None, :] - scores[:, None])
        cumulative = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slopes = np.hstack([np.zeros((n, 1)), below * (1 - below), np.zeros((n, 1))])
        each = np.arange(n)
        chance = np.maximum(cumulative[each, grades + 1] - cumulative[each, grades], 1e-12)
        upper, lower = slopes[each, grades + 1] / chance, slopes[each, grades] / chance
        by_threshold = np.array([-(upper[grades == j]).sum() + lower[grades == j + 1].sum() for j in range(top)]) / n
        by_score = (upper - lower) / n
        gradient = np.concatenate(
            [
                np.bincount(columns, values * by_score[rows], minlength=width) + 2 * ridge * weights,
                [by_threshold.sum()],
                np.cumsum(by_threshold[::-1])[::-1][1:] * steps,
            ]
        )
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        p = p - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return p[:width], p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``id``, ``text``, ``toxic`` of at most ``limit`` labelled documents; the sample is broadcast, as ``limit`` bounds it."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "id")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(cut(some)), "id")
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> OrdinalModel:
    """The model of a sample of ``docs`` (``doc_id``, ``text``) that ``labels`` (``doc_id``, ``toxic``) has.

    Without a toxic document, or without features, the model gives every text grade 0. A null
    text has no features; repeated ids count once, as toxic if any of their labels is. What comes
    to the driver is ``FEATURES`` features and, of ``limit`` documents, their counts.
    """
    sample = cut(labelled_sample(docs, labels, limit))
    sizes = {int(r.toxic > 0): r.n for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return OrdinalModel()

    def held(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, is_toxic in rows:
            for f in {f for word in set(words(text)) for f in features(word)}:
                yield f, int(is_toxic > 0)

    each = arrow_rows(sample.select("text", "toxic"), held, "feature string, toxic int", [pa.string(), pa.int32()], 32768)
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share_a, share_b = F.col("a") / toxic, F.col("b") / max(clean, 1)
    pooled = (F.col("a") + F.col("b")) / (toxic + clean)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / max(clean, 1)) + 1e-12)
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    deviations = (share_a - share_b) / spread
    chosen = (
        counts.where((deviations >= min(LEAST_DEVIATIONS, toxic**0.5)) & (odds >= LEAST_LOG_ODDS))
        .orderBy(F.desc(deviations), "feature")
        .limit(FEATURES)
        .collect()
    )
    names = [r.feature for r in chosen]
    if not names:
        return OrdinalModel()
    index = {name: i for i, name in enumerate(names)}

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = Known(index)
        for key, text, is_toxic in rows:
            found = known.counts(text)
            n = sum(1 for word in words(text) if known[word])
            yield key, int(is_toxic > 0), n, list(found.keys()), list(found.values())

    schema = "id bigint, toxic int, n int, f array<int>, c array<int>"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    vectors = arrow_rows(sample.select("id", "text", "toxic"), counted, schema, kinds).toPandas().sort_values("id")
    return _fitted(names, vectors)


def _fitted(names: list[str], vectors: pd.DataFrame) -> OrdinalModel:
    is_toxic = vectors.toxic.to_numpy() > 0
    found = vectors.n.to_numpy()[is_toxic]
    cuts = np.quantile(found, np.arange(1, GRADES) / GRADES)
    grades = np.zeros(len(vectors), dtype=np.int64)
    grades[is_toxic] = 1 + np.searchsorted(cuts, found, side="left")
    sizes = np.array([len(f) for f in vectors.f])
    rows = np.repeat(np.arange(len(vectors)), sizes)
    columns = np.array(list(chain.from_iterable(vectors.f)), dtype=np.int64)
    values = np.log1p(np.array(list(chain.from_iterable(vectors.c)), dtype=np.float64)) / np.log(2)
    weights, thresholds = fit_ordinal(rows, columns, values, grades, len(names))
    return OrdinalModel(names, weights, thresholds)


def graded(text: Column, model: OrdinalModel) -> Column:
    """For a text column a struct of ``expected_severity``, ``grade`` (the likeliest) and ``p_toxic`` (any grade above 0).

    A null or empty text has no features. The model, of at most ``FEATURES`` weights, goes along with the tasks.
    """

    @F.pandas_udf("expected_severity double, grade int, p_toxic double")
    def grade(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known({name: i for i, name in enumerate(model.names)})
        for texts in batches:
            scores = np.zeros(len(texts))
            for at, t in enumerate(texts):
                found = known.counts(t)
                if found:
                    scores[at] = sum(model.weights[f] * np.log2(1.0 + c) for f, c in found.items())
            at_most = model.at_most(scores)
            chances = np.diff(np.hstack([np.zeros((len(scores), 1)), at_most, np.ones((len(scores), 1))]), axis=1)
            yield pd.DataFrame(
                {
                    "expected_severity": (1 - at_most).sum(axis=1),
                    "grade": chances.argmax(axis=1).astype(np.int32),
                    "p_toxic": 1 - at_most[:, 0],
                }
            )

    return grade(text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict for every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", graded(F.col("text"), model).alias("g"))
    return found.select("doc_id", "g.*", (F.col("g.p_toxic") >= REJECTED).cast("int").alias("toxic"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
