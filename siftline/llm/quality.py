"""Document quality by co-training: two views of a document teach each other.

One classifier sees the text: its words, weighed by how much more often good or bad labelled documents
hold them, and how it is written and laid out. The other sees what is known of the document without its text: declared
source, language and length. Both start from a bounded sample of labelled documents. In each round
each scores all documents without a label, and all those of which it is sure become, as pseudo-labels, the other's
lessons. Pseudo-labels are never gathered: Newton's sums over them are computed where they are and added up, those of a class
weighing together as much as its labelled documents. Documents that look alike to both views teach once.
At last each view is calibrated on labelled documents kept apart, and so is the sum of the two log odds, which
scores all documents. Features are a few numbers a document, made in one pass over the texts; rounds run on these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from operator import add, eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import arrow_rows, cut, table

#: At most so many labelled documents, those whose ids' hashes are least; every fifth is kept for calibration.
LABELLED = 10_000
ROUNDS = 3
#: Newton steps of a view in a round, from where it stood.
STEPS = 3
#: A view teaches the documents of whose label it is at least this sure.
SURE = 0.97
#: Documents score as kept from this combined probability of being good.
KEPT = 0.5
BUCKETS = 8
#: Words that are weighed, at most, and by how many standard deviations either class must hold each more often; longer words are cut.
WORDS, DEVIATIONS, WORD_CHARS = 4096, 4.0, 32

CONTENT = ["words", "distinct", "word_length", "upper", "repeated", "marked", "digits", "lines", "blanks", "wide", "bare"]
METADATA = ["log_chars", *(f"source{i}" for i in range(BUCKETS)), *(f"lang{i}" for i in range(BUCKETS))]


def content(text: str, weights: dict[str, float]) -> list[float]:
    """What the text shows: the mean weight of its words; how many differ, how long, in capitals, like the one before, ending in
    signs, with digits; line ends, blanks, bytes a character, words that are single signs."""
    words = text.split()
    n, size = len(words) or 1, len(text) or 1
    return [
        sum([weights.get(w[:WORD_CHARS], 0.0) for w in words]) / n,
        len(set(words)) / n,
        sum(map(len, words)) / n / 10,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum([1 for w in words if not w[-1].isalnum()]) / n,
        sum(map(str.isdigit, words)) / n,
        100 * text.count("\n") / size,
        text.count(" ") / size,
        len(text.encode("utf-8", "surrogatepass")) / size,
        (text.count(" | ") + text.count("!")) / size * 10,
    ]


def metadata(n_chars: int | None, source: str | None, lang: str | None) -> list[float]:
    """What is declared: the length; source and language, hashed."""
    out = [float(np.log1p(max(n_chars or 0, 0)))]
    for value in (source, lang):
        bucket = [0.0] * BUCKETS
        if value is not None:
            bucket[xxhash.xxh64_intdigest(value) % BUCKETS] = 1.0
        out += bucket
    return out


def features(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``id`` and the two views' features (``content``, ``metadata``) of rows ``doc_id``, ``text``, ``source``, ``lang``, ``n_chars``; but
    for the first two, columns may be missing."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for key, text, origin, lang, n_chars in source:
            yield key, content(text or "", weights), metadata(n_chars, origin, lang)

    declared = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "bigint"))]
    narrow = docs.select(F.col("doc_id").cast("long"), "text", *declared)
    kind = pa.list_(pa.float64())
    return arrow_rows(narrow, rows, "id bigint, content array<double>, metadata array<double>", [pa.int64(), kind, kind], 16384)


def apart(id_column: Column) -> Column:
    """Which labelled documents are kept for calibration."""
    return F.pmod(F.xxhash64(F.lit("apart"), id_column), F.lit(5)) == 0


def word_weights(docs: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Log odds ratios of the words that stand in clearly more of the good, or of the bad, labelled documents, the ones kept apart left out.

    The driver gets ``WORDS`` words at most.
    """

    def held(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, good in rows:
            for w in {w[:WORD_CHARS] for w in (text or "").split()}:
                yield w, int(good > 0)

    taught = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample.where(~apart(F.col("id")))), "id")
    taught = cut(taught.groupBy("id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")))
    sizes = Counter({bool(r.good): r.n for r in taught.groupBy((F.col("quality") > 0).alias("good")).agg(F.count("*").alias("n")).collect()})
    good, bad = sizes[True], sizes[False]
    if not good or not bad:
        return {}
    each = arrow_rows(taught.select("text", "quality"), held, "word string, good int", [pa.string(), pa.int32()], 32768)
    counts = each.groupBy("word").agg(F.sum("good").alias("a"), F.sum(1 - F.col("good")).alias("b"))
    pooled = (F.col("a") + F.col("b")) / (good + bad)
    deviations = F.abs(F.col("a") / good - F.col("b") / bad) / F.sqrt(pooled * (1 - pooled) * (1 / good + 1 / bad) + 1e-12)
    odds = F.log((F.col("a") + 0.5) / (good - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (bad - F.col("b") + 0.5))
    chosen = counts.where(deviations >= DEVIATIONS).orderBy(F.desc(deviations), "word").limit(WORDS).select("word", odds.alias("odds")).collect()
    return {r.word: r.odds for r in chosen}


@dataclass
class View:
    """A logistic regression over a view's features and their squares, all to one scale."""

    column: str
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fitted(cls, column: str, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        weights = regression(wide((x - mean) / spread), y, ridge)
        return cls(column, mean, spread, weights)

    def wide(self, x: np.ndarray) -> np.ndarray:
        return wide((x - self.mean) / self.spread)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (self.wide(x) @ self.weights) + self.shift

    def taught(self, x: np.ndarray, y: np.ndarray, rows: DataFrame, teachers: list[View], steps: int = STEPS, ridge: float = 1.0) -> View:
        """After Newton steps over labelled rows and over those of ``rows`` that a teacher is sure of; classes of these weigh at most as much as their labelled rows."""
        w, own = self.weights, self.wide(x)
        for _ in range(steps):
            now = View(self.column, self.mean, self.spread, w)
            gradient, curve = newton_sums(own, y, w)
            for label, (n, g, h) in enumerate(lesson_sums(rows, now, teachers)):
                share = min(1.0, float((y == label).sum()) / n) if n else 0.0
                gradient, curve = gradient + share * g, curve + share * h
            w = w - np.clip(np.linalg.solve(curve + ridge * np.eye(len(w)), gradient + ridge * w), -2, 2)
        return View(self.column, self.mean, self.spread, w)

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        """Slope and shift that fit the log odds to labels that the weights have not seen."""
        raw = self.odds(x)
        shift, slope = regression(np.stack([np.ones(len(raw)), np.clip(raw, -20, 20)], axis=1), y, 0.1)
        return View(self.column, self.mean, self.spread, self.weights, float(slope), float(shift))

    def log_odds(self) -> Column:
        """``odds`` as an expression over the features' column, which runs in the JVM."""
        z = [
            F.least(F.greatest((F.col(self.column)[i] - float(m)) / float(s), F.lit(-LIMIT)), F.lit(LIMIT))
            for i, (m, s) in enumerate(zip(self.mean, self.spread, strict=True))
        ]
        terms = [F.lit(float(self.weights[0]))]
        for i, x in enumerate(z):
            terms += [x * float(self.weights[1 + 2 * i]), x * x * float(self.weights[2 + 2 * i])]
        return reduce(add, terms) * self.slope + self.shift


#: Features lie no further from the mean than so many spreads.
LIMIT = 6.0


def wide(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -LIMIT, LIMIT)
    return np.concatenate([np.ones((len(z), 1)), np.stack([z, z * z], axis=2).reshape(len(z), -1)], axis=1)


def regression(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; halved when a step does not help."""
    w = np.zeros(x.shape[1])
    cost = lambda v: np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + ridge * v @ v / 2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        now = cost(w)
        while cost(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def _summed(batches: Iterator[pa.RecordBatch], view: View, teachers: list[View]) -> Iterator[pa.RecordBatch]:
    """For rows of the pupil's and the teachers' features the count, gradient and curvature of each label, as numbers with their places.

    A row's label is that of the first teacher that is sure of it; without one it teaches nothing.
    """
    d, bound = len(view.weights), float(np.log(SURE / (1 - SURE)))
    totals = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if not batch.num_rows:
            continue
        own, theirs = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 1))
        odds = np.zeros(batch.num_rows)
        for teacher in teachers:
            odds = np.where(np.abs(odds) >= bound, odds, teacher.odds(theirs))
        x = view.wide(own)
        for one, some in ((0, x[odds <= -bound]), (1, x[odds >= bound])):
            g, h = newton_sums(some, np.full(len(some), float(one)), view.weights)
            totals[one] += np.concatenate([[len(some)], g, h.ravel()])
    if totals.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(totals.size, dtype=np.int32)), pa.array(totals.ravel())], names=["at", "s"])


def lesson_sums(rows: DataFrame, view: View, teachers: list[View]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Count, gradient and curvature over the lessons of labels 0 and 1; the driver gets as many numbers as one task makes."""
    d = len(view.weights)
    totals = np.zeros(2 * (1 + d + d * d))
    narrow = rows.select(view.column, teachers[0].column)
    for r in narrow.mapInArrow(partial(_summed, view=view, teachers=teachers), "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        totals[r["at"]] = r.s
    return [(t[0], t[1 : d + 1], t[d + 1 :].reshape(d, d)) for t in totals.reshape(2, -1)]


def labelled_ids(labels: DataFrame, limit: int) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").cast("long").alias("id"), "quality")


@dataclass
class Trained:
    """Both calibrated views, and slope and shift of the sum of their log odds."""

    content: View
    metadata: View
    slope: float
    shift: float

    def log_odds(self) -> Column:
        return (self.content.log_odds() + self.metadata.log_odds()) * self.slope + self.shift


def co_train(made: DataFrame, sample: DataFrame, rounds: int = ROUNDS) -> Trained | None:
    """The trained views, or None if the sample lacks one of the classes.

    ``made`` is what ``features`` gives, ``sample`` what ``labelled_ids`` gives, both written. The driver gets the labelled rows and sums.
    Repeated ids count once in the sample, and a label of 0 counts before a 1.
    """
    once = made.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("quality").alias("quality"), F.min(F.struct("content", "metadata")).alias("x"))
    rows = once.select("id", "quality", "x.*", apart(F.col("id")).alias("apart")).toPandas().sort_values("id")
    y, kept = (rows.quality.to_numpy() > 0).astype(float), rows.apart.to_numpy(dtype=bool)
    if min((y[~kept] > 0).sum(), (y[~kept] == 0).sum()) < 2 or min((y[kept] > 0).sum(), (y[kept] == 0).sum()) < 1:
        return None
    x = {c: np.array(rows[c].tolist(), dtype=float) for c in ("content", "metadata")}
    views = {c: View.fitted(c, x[c][~kept], y[~kept]) for c in x}
    if rounds:
        unlabelled = cut(made.join(F.broadcast(sample), "id", "left_anti").select("content", "metadata").distinct())
    # What a view was once taught stays: its teacher as it was in each round.
    taught_by: dict[str, list[View]] = {"content": [], "metadata": []}
    for _ in range(rounds):
        taught_by["content"].append(views["metadata"])
        taught_by["metadata"].append(views["content"])
        views = {c: views[c].taught(x[c][~kept], y[~kept], unlabelled, taught_by[c]) for c in views}
    views = {c: v.calibrated(x[c][kept], y[kept]) for c, v in views.items()}
    both = sum(views[c].odds(x[c][kept]) for c in views)
    shift, slope = regression(np.stack([np.ones(len(both)), np.clip(both, -20, 20)], axis=1), y[kept], 0.1)
    return Trained(views["content"], views["metadata"], float(slope), float(shift))


def quality(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, rounds: int = ROUNDS) -> DataFrame:
    """``id``, ``content_score``, ``metadata_score``, ``quality`` (probabilities of being good) of each row.

    Null texts are empty; repeated rows and null ids stay; an empty table gives none; missing or null metadata is a value of its own; texts are
    read whole, one at a time, however long. Without labels of both classes all scores are null.
    """
    sample = cut(labelled_ids(labels, limit))
    made = cut(features(docs, word_weights(docs, sample)))
    trained = co_train(made, sample, rounds)
    if trained is None:
        nothing = F.lit(None).cast("double")
        return made.select("id", nothing.alias("content_score"), nothing.alias("metadata_score"), nothing.alias("quality"))
    chance = lambda odds: F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    scores = {"content_score": trained.content, "metadata_score": trained.metadata, "quality": trained}
    return made.select("id", *[chance(v.log_odds()).alias(name) for name, v in scores.items()])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``, and whether each is kept."""
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), "content_score", "metadata_score", "quality", (F.col("quality") >= KEPT).cast("int").alias("keep")
    )


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
