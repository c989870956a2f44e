import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import toxicity


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    scores = x @ np.array([2.0, -1.0])
    grades = np.searchsorted([-1.0, 1.0, 2.5], scores + rng.logistic(size=3000))
    rows, columns = np.divmod(np.arange(6000), 2)
    weights, thresholds = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, 2)
    assert np.allclose(weights, [2, -1], atol=0.2) and np.allclose(thresholds, [-1, 1, 2.5], atol=0.25)


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 > 0"))
    held = docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("toxic", toxicity.graded(F.col("text"), model).alias("g")).select("toxic", "g.*").toPandas()
    flagged = held.p_toxic >= toxicity.REJECTED
    assert flagged[held.toxic == 1].mean() > 0.9
    assert flagged[held.toxic == 0].mean() < 0.01
    assert held.expected_severity[held.toxic == 1].mean() > held.expected_severity[held.toxic == 0].mean() + 1


def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = [rng.choice("abcdefghijklm") * 3 + rng.choice("nopqr") for _ in range(30)]
        for _ in range(i % 4 if i % 3 == 0 else 0):
            text[rng.randrange(30)] = rng.choice(["vilest", "vilify", "cursed"])
        rows.append((i, " ".join(text), int(any(w[0] in "vc" and len(w) > 4 for w in text))))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id bigint, text string, grade string, n int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    return docs, labels


def test_odd_rows_and_tables(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(1000, None, "", 0), (None, "vilest cursed vilify", "", 0), (1001, "", "", 0), (1001, "word " * 30000 + "vilest", "", 0), (3, "cursed", "", 0)], docs.schema)
    more = spark.createDataFrame([(1000, 1), (None, 1), (1002, 1), (1, None), (0, 0), (0, 0)], labels.schema)
    model = toxicity.fit(docs.union(odd), labels.union(more))
    assert "cursed" in model.names and "vili*" in model.names
    got = {(r.doc_id, r.text): r for r in odd.select("doc_id", "text", toxicity.graded(F.col("text"), model).alias("g")).select("doc_id", "text", "g.*").collect()}
    assert got[None, "vilest cursed vilify"].p_toxic > 0.5 > got[1000, None].p_toxic == got[1001, ""].p_toxic
    assert got[None, "vilest cursed vilify"].expected_severity > got[3, "cursed"].expected_severity > 0.5
    for none in (toxicity.fit(docs, labels.where("toxic = 0")), toxicity.fit(docs.where("false"), labels), toxicity.fit(docs, labels.where("false"))):
        assert {(r.g.expected_severity, r.g.grade, r.g.p_toxic) for r in docs.select(toxicity.graded(F.col("text"), none).alias("g")).collect()} == {(0.0, 0, 0.0)}
    assert docs.where("false").select(toxicity.graded(F.col("text"), model)).count() == 0


def test_features_scores_and_grades_recomputed(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    texts, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    of = lambda text: [f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)]]
    sizes, held = Counter(toxic.values()), Counter()
    for i, text in texts.items():
        held.update((f, toxic[i]) for f in set(of(text)))
    strength = {}
    for f in {f for f, _ in held}:
        a, b = held[f, 1], held[f, 0]
        pooled = (a + b) / sum(sizes.values())
        z = (a / sizes[1] - b / sizes[0]) / math.sqrt(pooled * (1 - pooled) * (1 / sizes[1] + 1 / sizes[0]) + 1e-12)
        odds = math.log((a + 0.5) / (sizes[1] - a + 0.5)) - math.log((b + 0.5) / (sizes[0] - b + 0.5))
        if z >= min(toxicity.LEAST_DEVIATIONS, math.sqrt(sizes[1])) and odds >= toxicity.LEAST_LOG_ODDS:
            strength[f] = z
    assert set(model.names) == set(strength) and len(strength) > 3
    weight = dict(zip(model.names, model.weights, strict=True))
    got = {r.doc_id: r for r in docs.select("doc_id", toxicity.graded(F.col("text"), model).alias("g")).select("doc_id", "g.*").collect()}
    for i, text in texts.items():
        score = sum(weight[f] * math.log2(1 + n) for f, n in Counter(of(text)).items() if f in weight)
        below = [1 / (1 + math.exp(-max(-40.0, min(40.0, t - score)))) for t in model.thresholds]
        chances = [y - x for x, y in zip([0, *below], [*below, 1], strict=True)]
        r = got[i]
        assert math.isclose(r.expected_severity, sum(1 - x for x in below), abs_tol=1e-9) and math.isclose(r.p_toxic, 1 - below[0], abs_tol=1e-9)
        assert math.isclose(chances[r.grade], max(chances), abs_tol=1e-9)


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    assert toxicity.labelled_sample(docs.union(docs), labels, 37).count() == 37
