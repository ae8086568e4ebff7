"""The proxy student and its fit: no place holds a coefficient a gram, and the result is the fit's that does."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillon.operators import dual, texts


@pytest.mark.parametrize("classes", [2, 3])
def test_dual_fit_is_the_primal_one(spark, classes, monkeypatch):
    monkeypatch.setattr(dual, "BLOCK", 16)
    rng = np.random.default_rng(classes)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.5)
    x[:, 0] += 0.5  # a gram of all texts
    y = (x[:, 1] > x[:, 2]).astype(int) + (classes == 3) * (x[:, 3] > 0.6)
    entries = [(f"g{j}", 1.0, i, float(x[i, j])) for j in range(12) for i in range(60) if x[i, j]]
    kept = dual.chunks(spark.createDataFrame(entries, "gram string, idf double, doc long, raw double").repartition("gram"), 40)
    assert kept.count() > 4
    a, b = dual.fitted(kept, y, classes, 3.0)
    got = {r.gram: r.weights for r in dual.coefficients(kept, a).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(float(t), Vectors.dense(v)) for t, v in zip(y, unit, strict=True)], ["label", "features"])
    model = LogisticRegression(regParam=1 / (3.0 * 60), standardization=False, maxIter=500, tol=1e-12).fit(rows)
    want = model.coefficientMatrix.toArray()
    assert np.allclose(np.array([got[f"g{j}"] for j in range(12)]).T, want, atol=2e-4)
    shift = b - model.interceptVector.toArray()
    assert np.allclose(shift - shift.mean() * (classes > 2), 0, atol=2e-4)


def test_student_of_three_labels_and_of_one(spark):
    words = {0: "red apple", 4: "blue steel", 7: "green grass"}
    train = spark.createDataFrame([(i, words[y], y) for i, y in enumerate([0, 4, 7] * 10)], "id long, text string, y int")
    test = spark.createDataFrame([(1, "an apple", 0), (2, "steel", 4), (3, "grass", 7), (4, None, 0)], "id long, text string, y int")
    got = {r.id: r.predicted for r in texts.student(train, test, "id", "y").collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 0, 2: 4, 3: 7} and got[4] in (0, 4, 7)
    assert {r.predicted for r in texts.student(train.where("y = 4"), test, "id", "y").collect()} == {4}
    assert texts.student(train.where(F.col("y") < 0), test, "id", "y").where("predicted is null").count() == 4


def test_products_read_runs_that_executors_hold(spark):
    """A pass reads a place an entry, not a value too, and no file; nothing is held after the fit."""
    entries = [(f"g{j}", 1.0, i, 1.5 if i % 7 else 2.5) for j in range(40) for i in range(j % 3, 300)]
    kept = dual.chunks(spark.createDataFrame(entries, "gram string, idf double, doc long, raw double").repartition(3, "gram"), 2000)
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    cells = dual.held(kept)
    assert sum(len(c) for row in cells.collect() for c in row) < 5 * len(entries)
    x = np.zeros((300, 40))
    for g, _, i, r in entries:
        x[i, int(g[1:])] = r
    a = np.random.default_rng(0).random((300, 2))
    assert np.allclose(dual.product(cells, 300, a), x @ (x.T @ a)) and np.allclose(dual.product(cells, 300, None)[:, 0], (x * x).sum(1))
    cells.unpersist()
    dual.fitted(kept, np.arange(300) % 2, 2, 3.0)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == before
