"""Linear heads fitted many at a time: regularised logistic and softmax regression, and logistic regression with an invariance penalty.

Every fit is a job: a value of C, a strength of the penalty, and the fold that it doesn't see. All jobs take their damped Newton steps
together: a pass over the labelled rows sums up loss, gradient and Hessian of every job inside the tasks, a shuffle of sums adds them up,
and the driver solves one small system a job. So the number of passes doesn't depend on how many values and folds there are. Rows are
what people have labelled; what a task holds is an Arrow batch, what the driver sees is (features + 1) squared numbers a job and class.

Objective of a job: C * sum(weight * log loss) + |coefficients|^2 / 2 + penalty * mean over rows with a twin of (p - p of the twin)^2;
intercepts are free. Two classes have one vector of coefficients, for the second; more have one each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import softmax

TWIN = "twin_"
FLOOR = 1e-9


@dataclass(frozen=True)
class Job:
    c: float
    penalty: float = 0.0
    held: int | None = None


def _curvature(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return (x * weight[:, None]).T @ x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _data_term(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log loss, its gradient and Hessian; b has a row per free class."""
    k, d = b.shape
    if k == 1:
        p = _sigmoid(x @ b[0])
        loss = -(w * np.log(np.clip(np.where(y == 1, p, 1 - p), FLOOR, 1))).sum()
        return loss, x.T @ (w * (p - y)), _curvature(x, w * p * (1 - p))
    z = x @ b.T
    e = np.exp(z - z.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    loss = -(w * np.log(np.clip(p[np.arange(len(y)), y.astype(int)], FLOOR, 1))).sum()
    off = p.copy()
    off[np.arange(len(y)), y.astype(int)] -= 1
    hessian = np.zeros((k * d, k * d))
    for i in range(k):
        for j in range(k):
            hessian[i * d : i * d + d, j * d : j * d + d] = _curvature(x, w * p[:, i] * ((i == j) - p[:, j]))
    return loss, ((w[:, None] * off).T @ x).ravel(), hessian


def _pair_term(x: np.ndarray, t: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of squared differences between rows and their twins, its gradient and Hessian."""
    p, q = _sigmoid(x @ b[0]), _sigmoid(t @ b[0])
    dp, dq, diff = p * (1 - p), q * (1 - q), p - q
    slope = x * dp[:, None] - t * dq[:, None]
    return (diff**2).sum(), 2 * slope.T @ diff, 2 * (slope.T @ slope + _curvature(x, diff * dp * (1 - 2 * p)) - _curvature(t, diff * dq * (1 - 2 * q)))


def _sums(features: Sequence[str], twins: bool, jobs: Sequence[Job], at: Sequence[int], params: np.ndarray):
    def matrix(batch: pa.RecordBatch, prefix: str = "") -> np.ndarray:
        return np.column_stack([np.ones(batch.num_rows), *[batch.column(prefix + f).to_numpy(zero_copy_only=False).astype(float) for f in features]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x, t = matrix(batch), matrix(batch, TWIN) if twins else None
            paired = ~np.isnan(t).any(1) if twins else None
            y, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight"))
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for i in at:
                seen = np.ones(len(y), bool) if jobs[i].held is None else fold != jobs[i].held
                parts = list(_data_term(x[seen], y[seen], w[seen], params[i])) + [w[seen].sum()]
                if jobs[i].penalty:
                    pairs = seen & paired
                    parts += [*_pair_term(x[pairs], t[pairs], params[i]), pairs.sum()]
                sums = np.concatenate([np.ravel(p) for p in parts])
                totals[i] = totals[i] + sums if i in totals else sums
        if totals:
            sizes = [len(s) for s in totals.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(totals), sizes), pa.int64()), pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int64()), pa.array(np.concatenate(list(totals.values())), pa.float64())], ["job", "at", "value"]
            )

    return run


def fitted(rows: DataFrame, features: Sequence[str], jobs: Sequence[Job], classes: int = 2, most: int = 200) -> np.ndarray:
    """(jobs, free classes, 1 + features), intercepts first. rows: y (0 to classes - 1), weight, fold, features, and their values of the
    twin under `twin_<feature>` (null without one) where a job has a penalty, which two classes alone can have. Each starts from zero."""
    twins = any(j.penalty for j in jobs)
    if twins and classes != 2:
        raise ValueError("the penalty compares one probability: it needs two classes")
    columns = ["y", "weight", "fold", *features, *([TWIN + f for f in features] if twins else [])]
    free, d = 1 if classes == 2 else classes, len(features) + 1
    n = free * d
    params, damping = np.zeros((len(jobs), free, d)), np.full(len(jobs), 1e-8)
    state: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * len(jobs)
    trial, active = params.copy(), list(range(len(jobs)))
    ridge = np.tile(np.concatenate([[0.0], np.ones(d - 1)]), free)
    kept = rows.select(*columns).persist()
    try:
        for _ in range(most):
            run = _sums(list(features), twins, jobs, active, trial)
            found: dict[int, dict[int, float]] = {}
            for r in kept.mapInArrow(run, "job long, at long, value double").groupBy("job", "at").agg(F.sum("value").alias("value")).collect():
                found.setdefault(r["job"], {})[r["at"]] = r["value"]
            left = []
            for i in active:
                got = found.get(i, {})
                v = np.array([got[k] for k in range(len(got))]) if got else np.zeros(2 + n + n * n)
                c, b = jobs[i].c, trial[i].ravel()
                loss, grad, hess, seen = v[0] * c, v[1 : 1 + n] * c, v[1 + n : 1 + n + n * n].reshape(n, n) * c, v[1 + n + n * n]
                loss, grad, hess = loss + 0.5 * (ridge * b * b).sum(), grad + ridge * b, hess + np.diag(ridge)
                if jobs[i].penalty and len(v) > 2 + n + n * n and v[-1]:
                    p, share = v[2 + n + n * n :], jobs[i].penalty / v[-1]
                    loss, grad, hess = loss + share * p[0], grad + share * p[1 : 1 + n], hess + share * p[1 + n : 1 + n + n * n].reshape(n, n)
                better = state[i] is None or loss <= state[i][0] + 1e-12 * abs(state[i][0])
                if better:
                    state[i], params[i], damping[i] = (loss, grad, hess), trial[i], damping[i] / 10
                else:
                    damping[i] = max(damping[i] * 10, 1e-6)
                if np.abs(state[i][1]).max() <= 1e-9 * max(1.0, c * seen / 1000) or damping[i] > 1e12:
                    continue
                while True:
                    try:
                        factor = np.linalg.cholesky(state[i][2] + damping[i] * np.eye(n))
                        break
                    except np.linalg.LinAlgError:
                        damping[i] = max(damping[i] * 10, 1e-6)
                step = np.linalg.solve(factor.T, np.linalg.solve(factor, -state[i][1]))
                if np.abs(step).max() < 1e-12:
                    continue
                trial[i] = params[i] + step.reshape(free, d)
                left.append(i)
            active = left
            if not active:
                break
    finally:
        kept.unpersist()
    if free > 1:  # what all intercepts have in common has no effect
        params[:, :, 0] -= params[:, :, 0].mean(1, keepdims=True)
    return params


def probabilities(features: Sequence[str], params: np.ndarray, fold: str | None = None, prefix: str = "") -> list[Column]:
    """The classes' probabilities of a row under params (free classes, 1 + features), or, with `fold`, under those of the row's fold, of
    params (folds, free classes, 1 + features)."""
    by = params if fold else params[None]
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(fold) + 1) if fold else F.lit(float(values[0]))
    logits = [sum((pick(by[:, k, j + 1]) * F.col(prefix + f) for j, f in enumerate(features)), pick(by[:, k, 0])) for k in range(by.shape[1])]
    if len(logits) == 1:
        p = 1 / (1 + F.exp(-F.least(F.greatest(logits[0], F.lit(-35.0)), F.lit(35.0))))
        return [1 - p, p]
    return softmax(logits)


def log_loss(y: Column, p: Sequence[Column], weight: str = "weight") -> Column:
    true = F.element_at(F.array(*p), y.cast("int") + 1)
    return -F.sum(F.col(weight) * F.ln(F.least(F.greatest(true, F.lit(FLOOR)), F.lit(1.0)))) / F.sum(weight)


def chosen_c(rows: DataFrame, features: Sequence[str], grid: Sequence[float], folds: int, classes: int = 2) -> tuple[float, np.ndarray, float]:
    """The value with the least weighted out-of-fold log loss (of equal ones the first), its coefficients by fold, and that loss."""
    found = fitted(rows, features, [Job(c, held=f) for c in grid for f in range(folds)], classes).reshape(len(grid), folds, -1, len(features) + 1)
    losses = rows.agg(*[log_loss(F.col("y"), probabilities(features, found[i], "fold")).alias(str(i)) for i in range(len(grid))]).first()
    best = min(range(len(grid)), key=lambda i: losses[i])
    return grid[best], found[best], losses[best]


def invariance_sweep(rows: DataFrame, features: Sequence[str], strengths: Sequence[float] = (0.1, 1.0, 10.0, 100.0), grid: Sequence[float] = (0.03, 0.1, 0.3), folds: int = 5, slack: float = 0.01, registered: Sequence[float] | None = None) -> DataFrame:
    """A row per strength, 0 first: penalty, c, oof_accuracy, oof_log_loss, oof_mean_shift (of a pair's probabilities), oof_flip_rate,
    n_pairs, intercept and weights of the fit to all rows, operating. C is chosen without a penalty and kept; every strength meets the
    same folds. Operating is the largest registered strength whose accuracy is within `slack` of that without a penalty, 0 if none is.
    Two rounds of fits, each all jobs at once, and one pass for the figures."""
    spark = rows.sparkSession
    c, base, _ = chosen_c(rows, features, grid, folds)
    points = [0.0, *[s for s in strengths if s]]
    jobs = [Job(c, s, f) for s in points[1:] for f in range(folds)] + [Job(c, s) for s in points]
    found = fitted(rows, features, jobs)
    by_fold = [base, *found[: len(jobs) - len(points)].reshape(-1, folds, 1, len(features) + 1)]
    whole = found[len(jobs) - len(points) :]
    paired = F.lit(True)
    for f in features:
        paired = paired & F.col(TWIN + f).isNotNull()
    figures = [F.count_if(paired).alias("n_pairs")]
    for i, params in enumerate(by_fold):
        p, q = probabilities(features, params, "fold"), probabilities(features, params, "fold", TWIN)
        figures += [
            F.avg(((p[1] >= 0.5).cast("int") == F.col("y")).cast("double")).alias(f"accuracy{i}"), log_loss(F.col("y"), p).alias(f"loss{i}"),
            F.avg(F.when(paired, F.abs(p[1] - q[1]))).alias(f"shift{i}"), F.avg(F.when(paired, ((p[1] >= 0.5) != (q[1] >= 0.5)).cast("double"))).alias(f"flip{i}"),
        ]
    got = rows.agg(*figures).first()
    allowed = set(strengths if registered is None else registered)
    within = [s for i, s in enumerate(points) if s and s in allowed and got[f"accuracy{i}"] >= got["accuracy0"] - slack]
    operating = max(within, default=0.0)
    out = [
        (s, float(c), got[f"accuracy{i}"], got[f"loss{i}"], got[f"shift{i}"] or 0.0, got[f"flip{i}"] or 0.0, got["n_pairs"], float(whole[i][0][0]), dict(zip(features, map(float, whole[i][0][1:]), strict=True)), s == operating) for i, s in enumerate(points)
    ]
    return spark.createDataFrame(out, "penalty double, c double, oof_accuracy double, oof_log_loss double, oof_mean_shift double, oof_flip_rate double, n_pairs long, intercept double, weights map<string,double>, operating boolean")
