"""The ordinal model: derivatives, grades, odd tables."""

from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import toxicity

WORDS = [f"w{i}" for i in range(400)]
ODD = [(5, " ".join(WORDS[:60])), (1, None), (2, ""), (3, " \t\n"), (6, "Vile"), (6, "vile"), (None, "vile awful vile"), (None, None), (7, "w " * 200_000)]


def documents(spark, rows):
    schema = "doc_id long, text string, toxic string, grade int, quality string, severity string"
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], schema)


def texts_and_labels(spark, n=360, long=False):
    """Toxic texts that are not of low quality have `awful` beside `vile`."""
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        w = [WORDS[k] for k in r.integers(0, 400, 30)]
        toxic, poor = i % 3 == 0, i % 2 == 0
        if toxic:
            w[3] = "vile"
            w[6] = f"nastyx{WORDS[i % 50]}"
        if toxic and not poor:
            w[9] = w[12] = "awful"
        rows.append((1000 + i, " ".join(w) + (" pad" * 8000 if long else "")))
        labels.append((1000 + i, int(toxic), int(not poor)))
    odd = [(None, 1, 1), (1, None, 0), (1000, 1, 0), (99, 1, 1)]
    return documents(spark, rows), spark.createDataFrame([(*x, "k") for x in labels + odd], "doc_id long, toxic int, quality int, text string")


@pytest.fixture(scope="module")
def fitted(spark):
    texts, labels = texts_and_labels(spark)
    return texts, labels, toxicity.train(texts, labels)


def test_derivatives_are_those_of_the_loss():
    r = np.random.default_rng(1)
    row, col = np.nonzero(r.random((40, 7)) < 0.4)
    d = toxicity.Design(row, col, r.random(len(row)), r.integers(0, 4, 40), 7)
    w, t = r.normal(size=7), r.normal(size=3)
    _, gw, gt = d.loss(w, t, 0.01)
    for x, g in ((w, gw), (t, gt)):
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-6
            up = d.loss(w + step if x is w else w, t + step if x is t else t, 0.01)[0]
            down = d.loss(w - step if x is w else w, t - step if x is t else t, 0.01)[0]
            assert np.isclose((up - down) / 2e-6, g[i], atol=1e-7)


def test_loss_is_that_of_the_link_function():
    d = toxicity.Design(np.array([0, 1, 2]), np.zeros(3, int), np.array([1.0, 2.0, 3.0]), np.array([0, 1, 2]), 1)
    w, t = np.array([0.5]), np.array([0.2, 0.1])
    theta = [0.2, 0.2 + np.exp(0.1)]
    s = lambda x: 1 / (1 + np.exp(-x))
    p = [s(theta[0] - 0.5), s(theta[1] - 1.0) - s(theta[0] - 1.0), 1 - s(theta[1] - 1.5)]
    assert np.isclose(d.loss(w, t, 0.0)[0], -np.mean(np.log(p)))


def test_thresholds_rise_and_weights_are_shared(fitted):
    model = fitted[2]
    assert len(model.thresholds) == 2
    assert model.thresholds == sorted(model.thresholds)
    assert model.weights["vile"] > 0


def test_grades_follow_the_labels(spark, fitted):
    texts, labels, model = fitted
    truth = {r["doc_id"]: r for r in labels.collect()}
    got = toxicity.score(texts, model).collect()
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]["toxic"]) for r in got]) > 0.97
    assert {r["grade"] for r in got} == {0, 1, 2}
    by = [np.mean([r["severity"] for r in got if (truth[r["doc_id"]]["toxic"], truth[r["doc_id"]]["quality"]) == k]) for k in ((0, 1), (1, 0), (1, 1))]
    assert by == sorted(by)
    assert all(0 <= r["severity"] <= 2 for r in got)


def test_held_out_texts_are_told_apart(spark):
    texts, labels = texts_and_labels(spark, 600)
    model = toxicity.train(texts, labels.filter("doc_id < 1400"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in toxicity.score(texts, model).collect() if r["doc_id"] >= 1400]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]) for r in got]) > 0.95


def test_long_texts_are_learnt_from_too(spark):
    texts, labels = texts_and_labels(spark, 120, long=True)
    assert "vile" in toxicity.train(texts, labels).weights


def test_labels_without_quality_have_one_threshold(spark, fitted):
    texts, labels, _ = fitted
    model = toxicity.train(texts, labels.drop("quality"))
    assert len(model.thresholds) == 1
    assert model.weights["vile"] > 0


def test_without_labels_severity_is_nought(spark, fitted):
    texts, labels, _ = fitted
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.train(texts, some)
        assert {r["severity"] for r in toxicity.score(documents(spark, ODD), model).collect()} == {0.0}


def test_odd_rows_are_scored_each(spark, fitted):
    model = fitted[2]
    got = toxicity.score(documents(spark, ODD).repartition(3), model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    assert len({r["severity"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_the_filter_keeps_rows_as_they_are(spark, fitted):
    texts, _, model = fitted
    kept = toxicity.toxicity_filter(texts, model)
    clean = {r["doc_id"] for r in toxicity.score(texts, model).collect() if not r["toxic"]}
    assert kept.columns == texts.columns
    assert {r["doc_id"] for r in kept.collect()} == clean
