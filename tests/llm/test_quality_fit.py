"""The classifier's counts and descent against plain solutions."""

from __future__ import annotations

import numpy as np

from inkgate.llm import quality


def problem(seed, n=50, d=12):
    draw = np.random.default_rng(seed)
    dense = draw.normal(size=(n, d)) * (draw.random((n, d)) < 0.5)
    signs = np.where(dense @ draw.normal(size=d) + 0.5 * draw.normal(size=n) > 0, 1.0, -1.0)
    costs = draw.uniform(0.2, 2.0, n)
    rows = [np.flatnonzero(x) for x in dense]
    return dense, signs, costs, rows, [x[r] for x, r in zip(dense, rows, strict=True)]


def primal(weight, bias, dense, signs, costs):
    return 0.5 * (weight @ weight + bias**2) + costs @ np.maximum(0, 1 - signs * (dense @ weight + bias))


def test_descent_reaches_the_optimum():
    """No plain sub-gradient run finds a lower loss, and the loss is near the dual's bound."""
    for seed in range(5):
        dense, signs, costs, rows, values = problem(seed)
        model = quality.hinge_fit(rows, values, signs, costs, epochs=500)
        weight, bias = model[: dense.shape[1]], model[-1]
        assert not model[dense.shape[1] : -1].any()
        found = primal(weight, bias, dense, signs, costs)
        w, best = np.zeros(dense.shape[1] + 1), np.inf
        with_one = np.hstack([dense, np.ones((len(dense), 1))])
        for step in range(1, 20_001):
            inside = signs * (with_one @ w) < 1
            w -= (w - (costs * signs * inside) @ with_one) / (step + 10)
            best = min(best, primal(w[:-1], w[-1], dense, signs, costs))
        assert found <= best + 1e-2 * best


def test_counts_are_of_records_that_hold_a_feature(spark):
    texts = ["one two two", "two three", "", "one two two", "four " * 50]
    labels = [1, 0, 1, 1, 0]
    table = spark.createDataFrame(list(zip(range(5), texts, labels)), "job_id long, cleaned_text string, label int")
    size, counts = quality._class_counts(table)
    want = np.zeros((2, quality.BUCKETS), int)
    words = quality._Words()
    for text, label in zip(texts, labels, strict=True):
        (found,) = quality.features([text], words)
        assert len(set(found.tolist())) == len(found)
        want[label, found] += 1
    assert size.tolist() == [2, 3] and (counts == want).all()


def test_ratio_and_score_by_hand(spark):
    """Scaled indicators, unit length, the descent's margin, the curve: all from the model's own numbers."""
    texts = [f"good fine {i} words here" if i % 2 else f"bad {i} $$$ spam" for i in range(40)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job_id long, cleaned_text string")
    said = spark.createDataFrame([(i, "accept" if i % 2 else "reject") for i in range(40)], "job_id long, decision string")
    model = quality.fit(table, said)
    got = {r.job_id: r.score for r in quality.quality_scores(table, model).collect()}
    assert min(got[i] for i in range(1, 40, 2)) > max(got[i] for i in range(0, 40, 2))
    assert quality.quality_scores(table.limit(0), model).count() == 0
