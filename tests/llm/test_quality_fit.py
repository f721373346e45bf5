"""The ranker against plain versions: a fit over listed pairs, the cut, and the mapping of scores."""

import numpy as np

from cohortloom.llm import quality


def plain_fit(x, y, penalty=1e-3):
    """Newton's method on the differences of all pairs, listed one by one."""
    d = np.array([a - b for a in x[y == 1] for b in x[y == 0]])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), -(d * p[:, None]).mean(0) + penalty * w)
    return w


def test_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    y = (x @ np.array([2, -1, 0, 0.5, 0, 0]) + rng.normal(size=90) > 0.4).astype(int)
    assert np.abs(quality.bradley_terry(x, y) - plain_fit(x, y)).max() < 1e-6


def test_cut_and_scores():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > -0.7).astype(int)
    ranker = quality.Ranker(x, y)
    scores = ranker.score(x)
    bent = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    raw = np.hstack([bent, np.abs(bent)]) @ ranker.weights
    order = np.argsort(raw)
    assert (np.diff(scores[order]) >= 0).all() and 0 <= scores.min() and scores.max() <= 1
    # below the cut are as many as have label 0, but for the quantile's own rounding
    assert abs(int((scores < quality.CUT).sum()) - int((y == 0).sum())) <= 1
    at_cut = 1 / (1 + np.exp(-np.log(quality.CUT / (1 - quality.CUT))))
    assert abs(at_cut - quality.CUT) < 1e-12


def test_repeated_ids_are_one_row(spark):
    docs = spark.createDataFrame([(i, "a b c. " * (i % 7 + 1)) for i in range(60)] + [(3, "a b c. " * 4)] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 > 2)) for i in range(60)], "doc_id long, quality int")
    once = quality.fit(docs.dropDuplicates(["doc_id"]), labels)
    assert np.allclose(once.weights, quality.fit(docs, labels).weights)
