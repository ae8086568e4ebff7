"""Heads fitted many at a time, against a plain minimisation by small steps."""

import math

import numpy as np
import pytest

from quillon.operators import fitting, newton


def rows_of(n=150, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (a - 0.5 * b + rng.logistic(size=n) > 0).astype(float)
    w = rng.choice([0.5, 1.0, 2.0], n)
    twin = rng.random(n) < 0.7
    return [(i, float(y[i]), float(w[i]), i % 5, float(a[i]), float(b[i]), float(a[i] + 1) if twin[i] else None, float(b[i]) if twin[i] else None) for i in range(n)]


SCHEMA = "item_id int, y double, weight double, fold int, a double, b double, twin_a double, twin_b double"


def minimum(rows, c, penalty, held=None):
    """Gradient descent with halved steps on the objective, its gradient by central differences."""
    seen = [r for r in rows if r[3] != held]
    x, y, w = np.array([[1, r[4], r[5]] for r in seen]), np.array([r[1] for r in seen]), np.array([r[2] for r in seen])
    pairs = [r for r in seen if r[6] is not None]
    own, twin = np.array([[1, r[4], r[5]] for r in pairs]), np.array([[1, r[6], r[7]] for r in pairs])
    s = lambda z: 1 / (1 + np.exp(-z))

    def loss(t):
        p = s(x @ t)
        return c * -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5 * (t[1:] ** 2).sum() + penalty * ((s(own @ t) - s(twin @ t)) ** 2).mean()

    grad = lambda t: np.array([(loss(t + h) - loss(t - h)) / 2e-5 for h in np.eye(3) * 1e-5])
    t, step = np.zeros(3), 0.1
    for _ in range(20000):
        g = grad(t)
        if np.abs(g).max() < 1e-8:
            break
        while loss(t - step * g) > loss(t) - 0.3 * step * (g * g).sum() and step > 1e-12:
            step /= 2
        t, step = t - step * g, step * 1.5
    return t


def test_fits_are_minima(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    jobs = [newton.Job(0.1), newton.Job(1.0, held=2), newton.Job(0.3, 5.0), newton.Job(0.3, 50.0, held=1)]
    found = newton.fitted(df, ["a", "b"], jobs)
    for job, got in zip(jobs, found, strict=True):
        assert np.allclose(got[0], minimum(rows, job.c, job.penalty, job.held), atol=2e-6)


def test_without_a_penalty_it_is_the_logistic_fit(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    model = fitting.logistic(df, ["a", "b"], 0.3)
    got = newton.fitted(df, ["a", "b"], [newton.Job(0.3)])[0][0]
    assert np.allclose(got, [model.intercept, *model.coefficients.toArray()], atol=1e-5)


def test_three_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 2))
    y = [int(v) for v in np.argmax(x @ np.array([[2.0, -1, 0], [0, 1, -2]]) + rng.gumbel(size=(90, 3)), 1)]
    df = spark.createDataFrame([(i, float(y[i]), 1.0, i % 5, *map(float, x[i])) for i in range(90)], "item_id int, y double, weight double, fold int, a double, b double")
    got = newton.fitted(df, ["a", "b"], [newton.Job(0.5)], 3)[0]
    z = np.column_stack([np.ones(90), x]) @ got.T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    off = p - np.eye(3)[y]
    gradient = 0.5 * off.T @ np.column_stack([np.ones(90), x]) + np.column_stack([np.zeros(3), got[:, 1:]])
    assert np.abs(gradient).max() < 1e-7 and abs(got[:, 0].sum()) < 1e-6
    found = fitting.fit_head(df, ["a", "b"], 250.0)
    assert found["status"] == "fitted" and len(found["heads"]) == 3 and found["accuracy"] > 0.5
    served = newton.probabilities(["a", "b"], got)
    one = df.where("item_id = 7").select(*[v.alias(f"p{i}") for i, v in enumerate(served)]).first()
    assert np.allclose(tuple(one), p[7])


def test_sweep(spark):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = newton.invariance_sweep(df, ["a", "b"], [0.1, 10.0, 1000.0], [0.1, 1.0], registered=[0.1, 10.0]).orderBy("penalty").collect()
    assert [r.penalty for r in got] == [0.0, 0.1, 10.0, 1000.0] and sum(r.operating for r in got) == 1 and not got[-1].operating
    c = got[0].c
    for r in got[:3]:
        folds = [minimum(rows, c, r.penalty, f) for f in range(5)]
        p = [1 / (1 + math.exp(-(folds[x[3]] @ [1, x[4], x[5]]))) for x in rows]
        q = [1 / (1 + math.exp(-(folds[x[3]] @ [1, x[6], x[7]]))) if x[6] is not None else None for x in rows]
        pairs = [(a, b) for a, b in zip(p, q, strict=True) if b is not None]
        assert r.oof_accuracy == pytest.approx(sum((a >= 0.5) == x[1] for a, x in zip(p, rows, strict=True)) / len(rows))
        assert r.oof_mean_shift == pytest.approx(sum(abs(a - b) for a, b in pairs) / len(pairs), abs=1e-5) and r.n_pairs == len(pairs)
        assert r.oof_flip_rate == pytest.approx(sum((a >= 0.5) != (b >= 0.5) for a, b in pairs) / len(pairs))
    assert got[-1].oof_mean_shift < got[0].oof_mean_shift
    largest = max((r.penalty for r in got if r.penalty in (0.1, 10.0) and r.oof_accuracy >= got[0].oof_accuracy - 0.01), default=0.0)
    assert next(r.penalty for r in got if r.operating) == largest


def test_a_penalty_needs_two_classes(spark):
    with pytest.raises(ValueError, match="two classes"):
        newton.fitted(spark.createDataFrame(rows_of(5), SCHEMA), ["a"], [newton.Job(1.0, 1.0)], 3)


def test_calibration_says_what_it_fell_back_to(spark):
    oof = spark.createDataFrame([(0.5 + i / 100, i % 2, 1.0) for i in range(20)], "confidence double, correct int, weight double")
    few, enough = fitting.calibrate(oof, "two_stage"), fitting.calibrate(oof, "temperature")
    assert (few.method, few.temperature, few.fallback_reason) == ("none", None, "20 out-of-fold rows; two_stage needs 50")
    assert enough.method == "temperature" and enough.fallback_reason is None and enough.temperature > 1 and enough.config()["temperature"] == enough.temperature
