import numpy as np
import pytest

from siftline.llm import quality as q


def test_regression_finds_the_weights():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((4000, 1)), rng.normal(size=(4000, 2))], axis=1)
    y = (x @ np.array([0.5, 2.0, -1.0]) + rng.logistic(size=4000) > 0).astype(float)
    assert np.allclose(q.regression(x, y, 0.01), [0.5, 2, -1], atol=0.2)


def test_views_score_alike_in_numpy_and_spark(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) * [1, 50, 0.1]
    view = q.View.fitted("content", x, (x[:, 1] > 3).astype(float)).calibrated(x, (x[:, 1] > 0).astype(float))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, content array<double>")
    got = [r.o for r in rows.select("id", view.log_odds().alias("o")).orderBy("id").collect()]
    assert np.allclose(got, view.odds(x))


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    held = labels.where("doc_id % 4 = 0").select("doc_id", "quality").withColumnsRenamed({"doc_id": "id", "quality": "label"})
    scored = q.quality(docs, labels.where("doc_id % 4 > 0")).join(held, "id").toPandas()
    assert len(scored) > 500
    right = (scored.quality >= q.KEPT) == (scored.label == 1)
    assert right[scored.label == 1].mean() > 0.99 and right[scored.label == 0].mean() > 0.85
    # Calibrated: of documents scored alike about so many are good.
    assert abs(scored.quality.mean() - scored.label.mean()) < 0.04


def made_up(spark):
    """Good texts, and two kinds of bad ones; labels know one kind, and a source that has both."""
    rng = np.random.default_rng(5)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "water", "and", "trees"], 40))
    spam = lambda: " ".join(rng.choice(["BUY!!!", "NOW!!!", "CHEAP!!!"], 40))
    junk = lambda: "\n".join(rng.choice(["x1", "7 7", "q | q | q", "||"], 60))
    rows, labels, truth = [], [], {}
    for i in range(3000):
        kind = i % 4
        text, source = [(good, "paper"), (spam, "farm"), (junk, "farm"), (junk if i % 8 == 3 else good, "mixed")][kind]
        text = text()
        rows.append((i, text, source, "en", len(text)))
        truth[i] = int("house" in text or "water" in text)
        if kind < 2 and i < 800:
            labels.append((i, 1 - kind, 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), truth


def test_pseudo_labels_teach_what_labels_do_not_show(spark):
    docs, labels, truth = made_up(spark)
    unseen = {i for i in truth if i % 8 == 3}
    share = {}
    for rounds in (0, 3):
        scores = {r.id: r.content_score for r in q.quality(docs, labels, rounds=rounds).collect()}
        share[rounds] = np.mean([(scores[i] >= 0.5) == truth[i] for i in unseen])
    assert share[3] > 0.95 and share[3] > share[0] + 0.3, share


def test_scores_of_the_query_recomputed(spark):
    """Features, word weights and scores of every document again, by plain loops over the driver's copy."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    sample = q.cut(q.labelled_ids(labels, q.LABELLED))
    weights = q.word_weights(docs, sample)
    apart = {r.id for r in sample.where(q.apart(q.F.col("id"))).collect()}
    label = {r.id: r.quality for r in sample.collect() if r.id not in apart}
    rows = [r for r in docs.collect()]
    held = {1: [set(r.text.split()) for r in rows if label.get(r.doc_id) == 1], 0: [set(r.text.split()) for r in rows if label.get(r.doc_id) == 0]}
    for word in list(weights)[:200]:
        a, b = (sum(any(w[: q.WORD_CHARS] == word for w in words) for words in held[c]) for c in (1, 0))
        odds = np.log((a + 0.5) / (len(held[1]) - a + 0.5)) - np.log((b + 0.5) / (len(held[0]) - b + 0.5))
        assert abs(odds - weights[word]) < 1e-9
    made = q.cut(q.features(docs, weights))
    trained = q.co_train(made, sample)
    got = {r.doc_id: r for r in q.op3_quality(spark, d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x, m = np.array([q.content(r.text, weights)]), np.array([q.metadata(r.n_chars, r.source, r.lang)])
        odds = [v.odds(z)[0] for v, z in ((trained.content, x), (trained.metadata, m))]
        want = [1 / (1 + np.exp(-o)) for o in (*odds, sum(odds) * trained.slope + trained.shift)]
        found = got[r.doc_id]
        assert np.allclose([found.content_score, found.metadata_score, found.quality], want, atol=1e-6)
        assert found.keep == int(found.quality >= q.KEPT)


def test_odd_rows_and_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.selectExpr("doc_id", "text", "source", "lang", "1 AS content", "'x' AS quality")
    odd = spark.createDataFrame([(None, "x", None, None, 1, ""), (1, None, "s", "en", 1, ""), (1, "", None, "de", 1, ""), (7, "word " * 50000, "s", None, 1, "")] * 2, docs.schema)
    more = spark.createDataFrame([(None, 1, 0), (1, None, 1), (10**9, 0, 0)], labels.schema)
    got = q.quality(docs.union(odd), labels.union(more), rounds=1).collect()
    assert len(got) == docs.count() + 8
    assert all(0 <= r.quality <= 1 for r in got)
    assert q.quality(docs.where("false"), labels).count() == 0
    assert {r.quality for r in q.quality(docs, labels.where("quality = 1")).collect()} == {None}


@pytest.mark.parametrize("text", ["", " ", "\n\n", "one", "a" * 1000])
def test_features_of_odd_texts(text):
    assert len(q.content(text, {})) == len(q.CONTENT) and len(q.metadata(None, None, "en")) == len(q.METADATA)
    assert all(np.isfinite(q.content(text, {"one": 2.0}) + q.metadata(-5, None, None)))
